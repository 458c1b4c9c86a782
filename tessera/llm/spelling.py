"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers, so anagrams share it and
an edit of one letter moves it by that letter's power, or by the difference of
two for an exchange.  An exchange value p(y) - p(x) splits over its two words:
each sends its key less each of its letters' powers, and equal differences are
one letter exchanged; a whole key equal to another's difference is one letter
added or removed.  So a word sends as many rows as it has distinct letters, not
one for each of the thousands of exchange values, and one equality join finds
every candidate.

Letter order is verified in two steps.  One edit leaves the half before or the
half behind it as it was, so the hash of a half is part of the join's key: the
candidates of a key are permutations of half a word.  The join's own condition
then takes the edit distance, and a pair that has both halves in common is
taken by the first, so each pair comes out once.

Counting is one aggregate, combined before its shuffle.  A form has at least
``ratio`` times its word's count, so chains have at most 27 steps for ratio 5
and 64-bit counts; roots follow by pointer doubling.

No join may broadcast: Spark judges a table by its compressed files, and a word
of some ten bytes there is dozens of rows of keys in memory, so a side that
looks small could fill the driver.

Defined results: null and empty texts have no words; a null id writes nothing
before the colon; repeated rows count again, ties go to the smallest word in
code-point order; other columns, whatever their names, are not read; a very long
text is held by one task (some 30 bytes a byte) and a very long word is one key
of one row each; an empty table, or one without repeats, gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import drop, written

#: Bytes of [A-Za-z] and of U+00C0 to U+00FF, which UTF-8 writes as C3 and one more.
LEAD = 0xC3
ASCII = np.zeros(256, bool)
ASCII[0x41:0x5B] = ASCII[0x61:0x7B] = True
#: Runs of more bytes than this take their checksum one by one.
LONG_RUN = 64
#: Fifth powers of the letters' codes; sums are taken modulo 2**64.
POWERS = np.arange(256, dtype=np.uint64) ** np.uint64(5)


@dataclass(frozen=True)
class Rules:
    """Words of at least ``min_letters`` and ``min_count``; a form has ``ratio``
    times its word's count.  Every ``slip``-th run (by checksum) loses a letter
    before it is counted; 0: none does."""

    min_letters: int = 6
    min_count: int = 5
    ratio: int = 5
    slip: int = 199


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of spans of bytes that continue the checksums ``before``."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(-lengths, kind="stable")
    long = int(np.searchsorted(-lengths[order], -LONG_RUN))
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes(), int(before[i]))
    order = order[long:]
    state, at, sizes = ~before[order], starts[order], lengths[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k))  # spans of more than k bytes come first
        state[:n] = CRC[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    return out


def chunk_words(data: np.ndarray, offsets: np.ndarray, heads: list[bytes], rules: Rules) -> tuple[pa.Array, pa.Array]:
    """Distinct results of a chunk of texts and their numbers; ``heads`` is what
    each text's checksums begin with."""
    data = K.LOWER[data]
    follows = np.concatenate(([False], data[:-1] == LEAD))
    starts, stops = K.spans(ASCII[data] | (data == LEAD) | follows, offsets)
    lengths = stops - starts
    marks = np.concatenate(([0], np.cumsum(data == LEAD)))
    letters = lengths - (marks[stops] - marks[starts])
    some = letters >= rules.min_letters  # a shorter run cannot become longer
    starts, lengths, letters = starts[some], lengths[some], letters[some]
    slipped = []
    if rules.slip:
        text = np.searchsorted(offsets, starts, "right") - 1
        before = np.array([zlib.crc32(h) for h in heads], np.uint32)
        sums = checksums(data, starts, lengths, before[text]) if len(starts) else np.zeros(0, np.uint32)
        hit = sums % rules.slip == 0
        for i in np.flatnonzero(hit):
            word = data[starts[i] : starts[i] + lengths[i]].tobytes().decode()
            at = int(sums[i]) % len(word)
            if len(word) > rules.min_letters:
                slipped.append(word[:at] + word[at + 1 :])
        starts, lengths = starts[~hit], lengths[~hit]
    words = K.binary_column(data[K.ranges(starts, lengths)], lengths, pa.string())
    counts = pc.value_counts(pa.chunked_array([words, pa.array(slipped, pa.string())]).combine_chunks())
    return counts.field(0), counts.field(1)


def count_words(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(word, n) of all texts, of words that are frequent enough."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offsets in K.chunks(batch.column(1)):
                heads = [f"{i or ''}:".encode() for i in ids[lo:hi]]
                yield pa.RecordBatch.from_arrays(list(chunk_words(data, offsets, heads, rules)), names=["word", "n"])

    found = df.select(F.col(doc_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null")
    return found.mapInArrow(K.task(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rules.min_count)


def chunk_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the word, letter taken out or 0, key) of a chunk of words: each
    distinct letter taken out and none, with the hash of either half."""
    at = np.flatnonzero((data & 0xC0) != 0x80)  # where letters begin
    first = np.searchsorted(at, offsets)
    size = np.diff(first)
    codes = K.codepoints(data).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(POWERS[codes], dtype=np.uint64)))
    whole = sums[first[1:]] - sums[first[:-1]]
    taken = np.unique(owner << 8 | codes)
    word = np.concatenate((taken >> 8, np.arange(len(size))))
    letter = np.concatenate((taken & 0xFF, np.zeros(len(size), np.int64)))
    left = whole[word] - POWERS[letter]
    rest = size[word] - (letter > 0)  # letters that the key sums
    half = rest // 2
    at = np.append(at, len(data))
    keyed = K.pair(left, rest.astype(np.uint64))
    front = K.span_hashes(data, offsets[word], at[first[word] + half])
    back = K.span_hashes(data, at[first[word + 1] - (rest + 1 - half)], offsets[word + 1])
    keys = np.concatenate((K.pair(keyed, front), K.mix(K.pair(keyed, back))))
    return np.tile(word, 2), np.tile(letter, 2), keys


def keyed_words(words: DataFrame) -> DataFrame:
    """(key, letter, back, word, n): ``letter`` is 0 where the key is the whole word's."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(0), 1 << 18):
                index, letter, keys = chunk_keys(data, offsets)
                back = np.arange(len(keys)) >= len(keys) // 2
                rows = batch.slice(lo, hi - lo).take(pa.array(index))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(letter.astype(np.int16)), pa.array(back), *rows.columns], names=["key", "letter", "back", "word", "n"])

    return words.select("word", "n").mapInArrow(K.task(run), "key long, letter short, back boolean, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words at one inserted, deleted or replaced
    letter, once."""
    rows = keyed_words(words)
    a = rows.where("letter > 0").select("key", F.col("letter").alias("a_letter"), F.col("back").alias("a_back"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = rows.select("key", F.col("letter").alias("b_letter"), F.col("back").alias("b_back"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    half = F.floor((F.char_length("a") - 1) / 2).cast("int")
    same_front = F.substring("a", F.lit(1), half) == F.substring("b", F.lit(1), half)
    exchanged = (F.col("b_letter") > 0) & (F.col("a") < F.col("b")) & (F.col("a_letter") != F.col("b_letter"))
    verified = (F.col("a_back") == F.col("b_back")) & ((F.col("b_letter") == 0) | exchanged) & (F.levenshtein("a", "b", 1) == 1) & ~(F.col("a_back") & same_front)
    return a.join(b.hint("merge"), "key").where(verified).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of each chain of forms."""
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while now.where("moved").limit(1).count():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = now.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, now = now, written(further, "spelling-roots")
        drop(before)
    return now.drop("moved")


def variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``df``."""
    words = written(count_words(df, doc_id, text, rules), "spelling-words")
    pairs = near_pairs(words).select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p"))
    best = pairs.groupBy("p.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("p.near_n")).alias("less"), "p.near")).alias("top"))
    enough = -F.col("top.less") >= rules.ratio * F.col("n")
    judged = written(
        words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("top.near")).alias("form"), F.when(enough, -F.col("top.less")).alias("form_n")),
        "spelling-forms",
    )
    drop(words)
    ends = roots(judged.where("form is not null"))
    return judged.join(ends.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
