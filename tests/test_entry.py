"""The driver contract survives without the training-data operators."""

import shutil
import subprocess
import sys

import pytest

from .conftest import ROOT

PROBE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), [n for n in q if n[:2] == 'op' and n[2].isdigit()], 'pipeline' in q, 'gcn_layer' in q)"


def copy(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("__pycache__"))
    return tmp_path


def said(folder, code=PROBE):
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env={"PYTHONPATH": str(folder), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_without_the_folders(tmp_path):
    folder = copy(tmp_path)
    shutil.rmtree(folder / "tessera" / "llm", ignore_errors=True)
    got = said(folder)  # corpus_pipeline.py is still there and cannot be imported
    assert got[2:] == ["[]", "False", "True"] and int(got[0]) > 100
    (folder / "corpus_pipeline.py").unlink(missing_ok=True)
    assert said(folder) == got


@pytest.mark.parametrize("package", ["zstandard", "ahocorasick", "public_tokenizers"])
def test_without_a_package(tmp_path, package):
    got = said(copy(tmp_path), f"import sys; sys.modules[{package!r}] = None; {PROBE}")
    assert int(got[0]) > 100 and got[-1] == "True"
