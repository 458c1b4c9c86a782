"""From documents to token ids: five stages, each by one operator of ``tessera.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; between stages the documents are Parquet files, each deleted once the next
is written.  All but the last stage return the columns of documents, and judge by
columns of their own, whatever else the documents carry.

Defined results: null and empty texts have no language and are rejected by the
first stage; null labels are not learned from; rows with a null ``doc_id`` pass
as documents of their own (the second stage keeps one of those with like texts);
of repeated rows and of ties the second stage keeps one; columns with the names
of a stage's outputs are kept and not read; a very long text is one row of each
stage, held by one task; an empty table passes through as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, decontaminate, language, paragraphs, simhash
from tessera.llm.shared import drop, fresh, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognised language and ambiguous ones; the
    others keep their label, or get the prediction where they have none."""
    model = language.fit(docs.where(~language.held_out()))
    lang, score, ambiguous = names = tuple(fresh(docs, n) for n in ("lang_pred", "lang_score", "lang_ambiguous"))
    found = language.predict(docs, model, names=names)
    kept = found.where((F.col(lang) != language.UND) & ~F.col(ambiguous))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has as well."""
    cut = paragraphs.remove(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long"))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which one word in twenty or more is a benchmark's."""
    words, spans, _ = names = tuple(fresh(docs, n) for n in ("n_words", "hit_spans", "hit_items"))
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names=names)
    return found.where(~decontaminate.contaminated(words, spans)).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, checked by decoding them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = byte_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path, ids="token_ids")
    return found.select(
        "doc_id",
        "lang",
        "source",
        byte_bpe.n_tokens(F.col("token_ids")).alias("n_tokens"),
        "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", encoding),
]

#: SQL cannot express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
