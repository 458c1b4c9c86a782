"""One text of tens of megabytes among short ones: results, and memory of the workers."""

import hashlib
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import byte_bpe, chat, decontaminate, extraction, interpolation, language, licenses, paragraphs, queries, repetition, simhash, spelling
from tessera.llm.shared import written

#: Bytes of the long text.
SIZE = int(os.environ.get("TEST_LONG_BYTES", 50 << 20))


def workers():
    """Processes of Python workers below this one."""
    up = {}
    for p in Path("/proc").glob("[0-9]*"):
        try:
            up[int(p.name)] = (int((p / "stat").read_text().rsplit(")", 1)[1].split()[1]), (p / "cmdline").read_bytes())
        except OSError:
            continue
    own = {os.getpid()}
    while more := {p for p, (q, _) in up.items() if q in own and p not in own}:
        own |= more
    return [p for p in own if b"pyspark.daemon" in up.get(p, (0, b""))[1]]


def peak():
    found = [0]
    for p in workers():
        try:
            found += [int(line.split()[1]) << 10 for line in Path(f"/proc/{p}/status").read_text().splitlines() if line.startswith("VmHWM")]
        except OSError:
            continue
    return max(found)


@pytest.fixture(scope="module")
def words():
    rng = np.random.default_rng(21)
    known = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(20000)])
    text = " ".join(known[rng.integers(0, len(known), SIZE // 7)].tolist())
    return (text + "\n") * (SIZE // len(text)) + text[: SIZE % (len(text) + 1)]


@pytest.fixture(scope="module")
def long_docs(spark, sf, words, tmp_path_factory):
    """Short documents of the table and the long one, on disk."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 20")
    one = spark.createDataFrame([(10**6, words, "en", "long", len(words))], "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path_factory.mktemp("long"))
    docs.unionByName(one.select(docs.columns)).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def measured(df):
    """(rows without long columns, peak of any worker in bytes for one of the text)."""
    for p in workers():
        Path(f"/proc/{p}/clear_refs").write_text("5")
    rows = {r.doc_id: r for r in df.collect()}
    return rows, (peak() - (300 << 20)) / SIZE


#: Greatest peak of a worker, in bytes for one of the text, beyond 300 MB.
LIMITS = {"op1": 45, "op3": 30, "op4": 55, "op6": 40, "op7": 70, "op8": 55, "op9": 30, "op10": 40, "op11": 30}


def run(name, spark, sf, df):
    small = df.select("doc_id", "text")
    if name == "op1":
        return interpolation.learn_and_score(df).select("doc_id", "n_tokens")
    if name == "op3":
        return paragraphs.find(df).select("doc_id", "n_words", "removed_words")
    if name == "op4":
        return licenses.find(small, keep_text=False).select("doc_id", "n_words")
    if name == "op6":
        return language.predict(small, language.fit(df)).select("doc_id", "lang_pred", "score")
    if name == "op7":
        return repetition.measure(small, keep_text=False)
    if name == "op8":
        return decontaminate.find(small, spark.read.parquet(f"{sf}/benchmark.parquet")).select("doc_id", "n_words", F.size("hit_spans").alias("n"))
    if name == "op9":
        return simhash.near_duplicates(df).select("doc_id", "fingerprint")
    if name == "op10":
        return byte_bpe.round_trip(small, queries.public_tokenizers.path("byte_bpe_50k.tiktoken")).select("doc_id", byte_bpe.n_tokens(F.col("ids")).alias("n"), F.sha2("decoded", 256).alias("h"))
    return spelling.variants(df).select(F.col("word").alias("doc_id"), "n")


@pytest.mark.parametrize("name", LIMITS)
def test_long_text(spark, sf, long_docs, words, name):
    rows, each = measured(run(name, spark, sf, long_docs))
    print("peak", name, round(each, 1))
    own = rows[10**6] if name != "op11" else None
    n = len(words.split())
    if name == "op10":
        assert own.h == hashlib.sha256(words.encode()).hexdigest()
    elif name == "op1":
        assert own.n_tokens == n + 1
    elif name in ("op3", "op4", "op7", "op8"):
        assert own.n_words == n
    elif name == "op6":
        assert own.lang_pred == "en"
    elif name == "op11":
        assert len(rows) > 5000
    assert each < LIMITS[name]
