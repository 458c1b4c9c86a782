"""The pipeline's stages on the table's documents, and on odd rows."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.shared import written

from .conftest import ODD
from .test_group_operators import fingerprint, linked, repeated_words
from .test_text_operators import TIK, brute_hits


@pytest.fixture(scope="module")
def stages(spark, sf, docs):
    out, now = {}, docs
    for name, f in corpus_pipeline.STAGES:
        now = written(f(spark, now, sf), f"t-{name}")
        out[name] = now
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(docs, stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].dtypes == docs.dtypes


def test_each_stage_does_its_work(spark, sf, docs, stages):
    before, after = rows(docs), rows(stages["language_id"])
    assert all(any(c.isalpha() for c in t) for t in after.values()) and len(after) >= 0.98 * len(before)
    before, after = after, rows(stages["simhash_near_dedup"])
    comp = linked([(i, fingerprint(t)) for i, t in before.items()])
    assert set(after) == {comp[fingerprint(t)] for t in before.values()}
    before, after = after, rows(stages["substring_dedup"])
    assert not repeated_words(after.items(), 50) and len(after) >= len(before) - 2
    hit = repeated_words(before.items(), 30)
    assert all(after[i] == t for i, t in before.items() if i not in hit)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = after, rows(stages["benchmark_decontamination"])
    bad = {i for i, t in before.items() if (h := brute_hits(items, t))[1] and 20 * h[1] >= h[0]}
    assert set(after) == set(before) - bad
    for r in stages["byte_bpe"].collect():
        assert r.n_tokens == len(TIK.encode_ordinary(after[r.doc_id]))


def test_run(spark, sf, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect())) == sorted(map(str, stages["byte_bpe"].select("doc_id", "ids_sha256").collect()))


def test_odd_rows(spark, sf, docs, odd):
    extra = odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    now = docs.unionByName(extra)
    for _, f in corpus_pipeline.STAGES:
        now = written(f(spark, now, sf), "t-odd")
    ids = collections.Counter(r.doc_id for r in now.collect())
    assert max(ids.values()) == 1 and None in ids
    empty = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        empty = written(f(spark, empty, sf), "t-empty")
    assert empty.count() == 0
    assert len(ODD) == 10


TAKEN = ["lang_pred", "lang_score", "lang_ambiguous", "n_words", "hit_spans", "hit_items", "_doc", "_key", "_cut", "_words", "_left", "fingerprint", "component_id", "ids", "token_starts", "decoded", "token_ids", "hit_ids", "text_key", "spans"]


def test_columns_with_clashing_names_change_nothing(spark, sf, docs, stages):
    now, before = docs, docs
    for name, f in corpus_pipeline.STAGES:
        given = now
        for k, c in enumerate(TAKEN):
            given = given.withColumn(c, F.lit("und" if c == "lang_pred" else f"own {k}"))
        got = written(f(spark, given, sf), "t-names")
        if name != "byte_bpe":
            assert got.columns == given.columns
            assert all(set(r) == {"und" if c == "lang_pred" else f"own {k}" for k, c in enumerate(TAKEN)} for r in got.select(*TAKEN).distinct().collect())
        assert sorted(map(str, got.select(stages[name].columns).collect())) == sorted(map(str, stages[name].collect())), name
        before, now = now, stages[name]
    assert before is not docs
