import re

import pytest


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def graphic(s):
    """Words [^\\x20\\x09-\\x0D]+ ."""
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def alnum(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))


#: Nulls, blanks, one very long text, ties, repeats and odd characters.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "The quick brown fox jumps over the lazy dog again and again"),
    (5, "The quick brown fox jumps over the lazy dog again and again"),
    (None, "ünï cödé ﬀ 漢字 😀 it's THE end"),
    (7, "word " * 30000),
    (8, "x" * 5000),
    (9, "!!! ??? 123"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
