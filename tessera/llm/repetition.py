"""Quality rules from the suffix array of each text's words.

The suffixes of a chunk's texts are sorted side by side by prefix doubling:
ranks hold the text, so suffixes of different texts never meet, and a round
refines only groups that are still tied.  Longest common prefixes of
neighbours follow from the ranks of all rounds, longest step first.  The LCP
intervals' maximal repeated substrings are, for each place, the longest
substring that begins there and occurs again; their spans are unioned.  A text
is kept if the union of long repeats covers a limited fraction of its words and
the longest repeat is limited.

Defined results: null and empty texts have no words, no repeats and zero
everywhere (so the base rule fails them for being short).  Texts are judged
one by one, so ties, repeats and null keys need no rule; other columns stay.  A
very long text is held whole by one task, with some 100 bytes a word and 4 more
for each doubling of its longest repeat: 10**7 words, all equal, take 2 GB.  An empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import fresh

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Repeats of at least ``min_repeat`` words may cover ``max_covered`` of the
    words; no repeat may exceed ``max_longest`` words and ``max_longest_share``
    of the text at once."""

    min_repeat: int = 8
    max_covered: float = 0.3
    max_longest: int = 100
    max_longest_share: float = 0.15


def suffix_ranks(items: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... items; equal ranks:
    equal prefixes in one text.  The last array orders the suffixes fully.

    ``owner`` is the text of each item, ``ends`` its text's end.
    """
    n = len(items)
    _, index, size = np.unique(K.pair(items, owner.astype(np.uint64)), return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - size)[index]  # the place of a group's first in the order
    levels = [rank.astype(np.int32)]
    tied = np.flatnonzero(size[index] > 1)
    step = 1
    while len(tied):
        ahead = tied + step
        second = np.where(ahead < ends[tied], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key, tied = key[order], tied[order]
        first = K.runs(key)
        group = K.runs(rank[tied])  # tied is in order of its old rank
        base = np.repeat(group, np.diff(np.append(group, len(tied))))
        sizes = np.diff(np.append(first, len(tied)))
        new = rank[tied] + np.repeat(first, sizes) - base
        rank = rank.copy()
        rank[tied] = new
        levels.append(rank.astype(np.int32))
        tied = tied[np.repeat(sizes, sizes) > 1]
        step *= 2
    return levels


def repeat_lengths(items: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place the length of the longest substring that begins there and
    occurs at another place of its text, in items."""
    n = len(items)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    levels = suffix_ranks(items, owner, ends)
    array = np.argsort(levels[-1], kind="stable")
    near = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]])  # neighbours that share a first item
    a, b = array[near], array[near + 1]
    lcp = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        inside = (x < ends[a]) & (y < ends[b])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        # equal ranks of 2^k items; a suffix that ends sooner has a rank of its own
        same = inside & (levels[k][x] == levels[k][y])
        lcp[same] += 1 << k
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def covered(lengths: np.ndarray, least: int, bounds: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a repeat of at least ``least`` words."""
    n = len(lengths)
    some = np.flatnonzero(lengths >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, some, 1)
    np.add.at(edge, some + lengths[some], -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return inside[bounds[1:]] - inside[bounds[:-1]]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_long_repeat_words", "longest_repeat")


def chunk_measures(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> list[np.ndarray]:
    """FIELDS of a chunk of texts."""
    graphic = K.GRAPHIC[data]
    starts, stops = K.spans(graphic, offsets)
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    owner = np.repeat(np.arange(len(words)), words)
    lengths = repeat_lengths(K.span_hashes(data, starts, stops), owner, np.repeat(bounds[1:], words))
    longest = np.zeros(len(words), np.int64)
    some = words > 0
    if some.any():
        longest[some] = np.maximum.reduceat(lengths, bounds[:-1][some])
    # lines with a word, and of these the distinct ones
    line_start, line_stop = K.spans(data != 0x0A, offsets)
    inked = np.concatenate(([0], np.cumsum(graphic)))
    real = inked[line_stop] > inked[line_start]
    line_start, line_stop = line_start[real], line_stop[real]
    text = np.searchsorted(offsets, line_start, "right") - 1
    distinct = np.unique(np.stack([text.astype(np.uint64), K.span_hashes(data, line_start, line_stop)]), axis=1)[0].astype(np.int64) if len(text) else text
    dup = np.bincount(text, minlength=len(words)) - np.bincount(distinct, minlength=len(words))
    return [words, _per_text(graphic & ((data & 0xC0) != 0x80), offsets), _per_text(SYMBOLS[data], offsets), dup, covered(lengths, 3, bounds), covered(lengths, rules.min_repeat, bounds), longest]


def measure(df: DataFrame, text: str = "text", rules: Rules = Rules(), keep_text: bool = True) -> DataFrame:
    """Adds FIELDS: words, their code points, symbols, repeated lines, words in
    repeats of three words or more, words in long repeats, and the longest repeat."""
    names = [fresh(df, f) for f in FIELDS]
    schema = T.StructType([*(f for f in df.schema.fields if keep_text or f.name != text), *(T.StructField(n, T.LongType()) for n in names)])
    at, columns = df.columns.index(text), schema.names

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(at), 1 << 20):
                rows = [c for i, c in enumerate(batch.slice(lo, hi - lo).columns) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays([*rows, *(pa.array(x, pa.int64()) for x in chunk_measures(data, offsets, rules))], names=columns)

    return df.mapInArrow(run, schema)


def base_failed():
    """Fewer than 50 words, or more than half of them in repeated windows of three."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def accepted(rules: Rules = Rules()):
    """The suffix array's verdict."""
    share = F.col("n_long_repeat_words") <= F.lit(rules.max_covered) * F.col("n_words")
    longest = (F.col("longest_repeat") <= rules.max_longest) | (F.col("longest_repeat") <= F.lit(rules.max_longest_share) * F.col("n_words"))
    return share & longest
