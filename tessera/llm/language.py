"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1 bits.  For each bit a binary
classifier over hashed byte n-grams (n = 1 to 4) tells the languages that have
+1 there from the others: naive Bayes log odds, averaged over a text's n-grams
and scaled.  Decoding adds up, over bits, the logistic loss of each
classifier's margin against each codeword, weighted by how well that bit
separates the training languages; the codeword of least loss wins.  If the
runner-up is nearly as near, the text is flagged as ambiguous.

The n-gram counts of each language come from all labelled training texts: each
task adds up its texts in one table (languages x buckets) and the tables are
summed by Spark.  Only the final table reaches the driver; its size is bounded
by ``MAX_LANGUAGES`` x ``BUCKETS`` whatever the corpus.  No sample is taken.

Defined results: ``und`` (score 0, not ambiguous) for a null or empty text, one
without a letter, and for every text if no label could be learned.  Null labels
are not learned from.  Rows are independent, so ties and repeats need no rule;
equal losses go to the first language by name.  Other columns are kept, whatever
their names.  A very long text is read by one task in slices, with some 10 bytes
a byte of text.  An empty table gives no rows, and nothing can be learned from it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .byte_bpe import LETTER, class_table
from .shared import fresh

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
#: More labels than this are an error; it bounds the table of counts.
MAX_LANGUAGES = 400
#: Margins are averages of log odds, scaled by this; it sharpens the losses.
SCALE = 8.0
#: A text is ambiguous if the runner-up's share is at least this part of the winner's.
NEAR = 0.8
UND = "und"
#: Texts scored together; their count table has GROUP x BUCKETS cells.
GROUP = 64
#: Bytes of text whose n-grams are held at a time.
SLICE = 1 << 19


def features(data: np.ndarray, offsets: np.ndarray, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, text of each n-gram) of the n-grams that begin at
    the bytes lo <= i < hi, each within one text."""
    hi = len(data) if hi is None else hi
    lower = K.LOWER[data[lo : hi + max(ORDERS) - 1]].astype(np.uint32)
    own = np.diff(np.clip(offsets, lo, hi))
    left = np.repeat(offsets[1:], own) - np.arange(lo, hi)  # bytes to the text's end
    text = np.repeat(np.arange(len(own)), own)
    gram = np.zeros(hi - lo, np.uint32)
    buckets, texts = [], []
    for k in ORDERS:
        n = max(0, min(hi - lo, len(lower) - k + 1))
        gram[:n] = gram[:n] * np.uint32(257) + lower[k - 1 : k - 1 + n] + np.uint32(1)
        h = (gram ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        whole = left >= k
        buckets.append((h >> np.uint32(17))[whole])
        texts.append(text[whole])
    return np.concatenate(buckets), np.concatenate(texts)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, BUCKETS): how many n-grams of each text fall in each bucket; read
    in slices of bounded size, so that a long text takes no more than they do."""
    n = len(offsets) - 1
    out = None
    for lo in range(0, max(1, len(data)), SLICE):
        bucket, owner = features(data, offsets, lo, min(len(data), lo + SLICE))
        found = np.bincount(owner * BUCKETS + bucket, minlength=n * BUCKETS)
        out = found if out is None else out + found
    return out.reshape(n, BUCKETS)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1.  Few classes get every split of the classes once;
    many get the rows of a Walsh-Hadamard matrix, half of whose bits differ."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = range(1, 1 << (n - 1))
        return np.array([[1 if s >> k & 1 else -1 for s in splits] for k in range(n)], float)
    size = 1 << n.bit_length()
    i = np.arange(size)
    return np.where(np.bitwise_count(i[1 : n + 1, None] & i[None, 1:]) % 2, 1.0, -1.0)


@dataclass(frozen=True)
class Model:
    """Languages by name, their codewords, and log odds by bucket and bit."""

    languages: tuple[str, ...]
    codes: np.ndarray
    odds: np.ndarray
    bit_weights: np.ndarray


def counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n): n-grams of each language over all rows."""
    data = df.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")

    def run(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            names, column = batch.column(1), batch.column(0)
            for name in pc.unique(names).to_pylist():
                own = column.filter(pc.equal(names, name))
                if name not in tables:
                    if len(tables) >= MAX_LANGUAGES:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
                    tables[name] = np.zeros(BUCKETS, np.int64)
                for _, _, raw, offsets in K.chunks(own, SLICE):
                    for lo in range(0, len(raw), SLICE):
                        tables[name] += np.bincount(features(raw, offsets, lo, min(len(raw), lo + SLICE))[0], minlength=BUCKETS)
        for name, table in tables.items():
            some = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(table[some])], names=["lang", "bucket", "n"])

    return data.mapInArrow(K.task(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learns from all rows whose text and label are not null."""
    table = counts(df, text, lang).toPandas()
    names = tuple(sorted(table.lang.unique()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    seen = np.zeros((len(names), BUCKETS))
    at = {name: k for k, name in enumerate(names)}
    seen[table.lang.map(at).to_numpy(np.int64), table.bucket.to_numpy(np.int64)] = table.n.to_numpy(np.float64)
    p = (seen + 0.5) / (seen.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    codes = codewords(len(names))
    odds = np.zeros((BUCKETS, codes.shape[1]))
    weights = np.ones(codes.shape[1])
    if len(names) > 1:
        for b in range(codes.shape[1]):
            plus, minus = p[codes[:, b] > 0].mean(axis=0), p[codes[:, b] < 0].mean(axis=0)
            odds[:, b] = np.log(plus) - np.log(minus)
        expected = p @ odds  # the margin that each language has on average
        weights = np.maximum((expected * codes).min(axis=0), 0.02)
        weights /= weights.sum()
    return Model(names, codes, odds.astype(np.float32), weights)


def _decode(margins: np.ndarray, model: Model) -> np.ndarray:
    """The share of each language: a softmax of its negative weighted loss."""
    loss = np.log1p(np.exp(-np.clip(SCALE * margins[:, None, :] * model.codes[None], -60, 60))) @ model.bit_weights
    near = np.exp((loss.min(axis=1, keepdims=True) - loss) * len(model.bit_weights))
    return near / near.sum(axis=1, keepdims=True)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a code point of a letter category."""
    if not len(data):
        return np.zeros(len(offsets) - 1, bool)
    letters = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    found = np.logical_or.reduceat(np.append(letters, False), offsets[:-1]) & (np.diff(offsets) > 0)
    for i in np.flatnonzero(~found):
        lo, end = offsets[i], offsets[i + 1]
        while lo < end and not found[i]:
            hi = min(end, lo + SLICE)
            while hi < end and data[hi] & 0xC0 == 0x80:  # a code point is never cut
                hi += 1
            found[i] = (class_table()[K.codepoints(data[lo:hi])] == LETTER).any()
            lo = hi
    return found


def judge(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the language, behind the last one for none; its share; whether the
    runner-up is near) of each text."""
    n = len(offsets) - 1
    best, share, near = np.full(n, len(model.languages)), np.zeros(n), np.zeros(n, bool)
    if not model.languages or not len(data):
        return best, share, near
    margins = np.zeros((n, model.odds.shape[1]))
    for a in range(0, n, GROUP):
        b = min(n, a + GROUP)
        grams = gram_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).astype(np.float32)
        margins[a:b] = grams @ model.odds / np.maximum(grams.sum(axis=1, keepdims=True), 1)
    shares = _decode(margins, model)
    some = has_letter(data, offsets)
    best = np.where(some, shares.argmax(axis=1), best)
    share = np.where(some, shares.max(axis=1), 0)
    if len(model.languages) > 1:
        near = some & (np.partition(shares, -2, axis=1)[:, -2] >= NEAR * share)
    return best, share, near


def predict(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """``df`` with the predicted language, its share (0 to 1) and the ambiguity flag."""
    names = tuple(fresh(df, n) for n in names)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])
    at, columns = df.columns.index(text), schema.names
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        labels = np.array([*model.languages, UND], object)
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(at), SLICE):
                best, share, near = judge(data, offsets, model)
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(labels[best], pa.string()), pa.array(share), pa.array(near)], names=columns)

    return df.mapInArrow(K.task(run), schema)


def held_out(doc_id: str = "doc_id", modulus: int = 4, remainder: int = 2):
    """Whether a row is left out of training, by the checksum of its id; a null id: no."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus)) == remainder, F.lit(False))
