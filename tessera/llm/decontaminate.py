"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised to words; each window of 13 consecutive words
(an item with fewer words is one window) becomes a pattern with a blank at each
end.  A document's normal form is scanned once; a match's end gives the matched
words, and the words' byte spans give offsets in the original text.

An automaton is held by every worker, so it serves while the windows fit in
``AUTOMATON_BYTES``.  The windows of a larger benchmark are joined: hashes of a
document's windows that pass a Bloom filter of fixed size (the only thing that
is broadcast) meet the benchmark's windows by 128 bits of hash, and spans and
items are gathered by text.

Defined results: a null or empty text has no words and no hit; a null or empty
item has no window; windows that several items share report all of them; a
repeated ``item_id`` counts once, a null one is no item.  Matches of different
windows are unioned.  Rows are independent, so ties, repeated documents and null
keys need no rule.  Other columns are kept, and output columns get underscores
where a name is taken.  A very long text is held whole by one task, with some 45
bytes a byte of text, and its spans are one row.  An empty
table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import fresh

WINDOW = 13
#: An automaton holds at most so many pattern bytes; more are joined.
AUTOMATON_BYTES = 8 << 20
#: Bits of the filter that spares most of the documents' windows the join.
FILTER_BITS = 1 << 27

SPAN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("first_word", "end_word", "start_byte", "end_byte")])


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(normal form of all texts, word starts, word ends, byte place in the
    normal form of the blank after each word).  Words are parted by one blank,
    and each text begins and ends with a line feed."""
    lower = K.LOWER[data]
    starts, ends = K.spans(K.ALNUM[lower], offsets)
    lengths = ends - starts
    per_text = np.searchsorted(starts, offsets)
    # one byte after every word, and one before each text's first
    begin = np.cumsum(lengths + 1) - lengths - 1
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(per_text))
    begin += 2 * text_of + 2  # "\n " before a text's first word
    out = np.full(int(lengths.sum()) + len(lengths) + 2 * (len(offsets) - 1) + 2, 0x20, np.uint8)
    first_at = np.concatenate((begin, [len(out)]))[np.minimum(per_text[:-1], len(begin))] - 2
    out[first_at[np.diff(per_text) > 0]] = 0x0A
    out[K.ranges(begin, lengths)] = lower[K.ranges(starts, lengths)]
    return out.tobytes(), starts, ends, begin + lengths


SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: str):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct (window, item_id) of a benchmark table, DataFrame operations only."""
    words = F.filter(F.split(_lower(text), SEPARATORS), lambda w: w != "")
    some = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    return some.select("item_id", F.explode(F.transform(starts, lambda i: F.concat_ws(" ", F.slice("words", i, size)))).alias("window")).distinct()


def _automaton(patterns: list[tuple[str, list]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (window, ids) in enumerate(patterns):
        found.add_word(f" {window} ", (window.count(" ") + 1, k, ids))
    found.make_automaton()
    return found


#: The automaton of the running scan, kept by a worker process.
_built: dict[str, object] = {}


def _union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals that are sorted by start."""
    reach = np.maximum.accumulate(ends)
    first = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[first], np.append(reach[:-1][first[1:]], reach[-1])


def _scan(docs: DataFrame, text: str, patterns: list[tuple[str, list]], names: tuple[str, str, str], id_type: T.DataType) -> DataFrame:
    shared, token = docs.sparkSession.sparkContext.broadcast(patterns), uuid.uuid4().hex
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(SPAN, False)), T.StructField(names[2], T.ArrayType(id_type))])
    at, columns = docs.columns.index(text), schema.names
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type.simpleString()]
    spans_type = pa.list_(pa.field("element", pa.struct([pa.field(f.name, pa.int64(), False) for f in SPAN.fields]), False))

    def run(batches):
        if token not in _built:
            _built.clear()
            _built[token] = _automaton(shared.value) if shared.value else None
        automaton = _built[token]
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(at)):
                normal, starts, ends, after = normalise(data, offsets)
                words = np.diff(np.searchsorted(starts, offsets))
                base = np.concatenate(([0], np.cumsum(words)))
                spans: list[list] = [[] for _ in range(hi - lo)]
                ids: list[list] = [[] for _ in range(hi - lo)]
                hits = []
                if automaton is not None:
                    # bytes as Latin-1 characters: one place a byte
                    hits = [(e, *v) for e, v in automaton.iter(normal.decode("latin-1"))]
                if hits:
                    last = np.searchsorted(after, np.array([h[0] for h in hits]))
                    first = last - np.array([h[1] for h in hits]) + 1
                    kinds = np.array([h[2] for h in hits])
                    owner = np.searchsorted(base, first, "right") - 1
                    order = np.lexsort((first, owner))
                    for group in np.split(order, K.runs(owner[order])[1:]):
                        d = int(owner[group[0]])
                        a, b = _union(first[group], last[group] + 1)
                        spans[d] = [dict(first_word=int(x - base[d]), end_word=int(y - base[d]), start_byte=int(starts[x] - offsets[d]), end_byte=int(ends[y - 1] - offsets[d])) for x, y in zip(a, b, strict=True)]
                        ids[d] = sorted({i for k in np.unique(kinds[group]) for i in shared.value[k][1]}, key=str)
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(words, pa.int64()), pa.array(spans, spans_type), pa.array(ids, pa.list_(arrow_id))], names=columns)

    return docs.mapInArrow(K.task(run), schema)


def _hashes(data: np.ndarray, offsets: np.ndarray, sizes: list[int]):
    """(word starts, word ends, bounds of the texts' words, and for each size the
    first words of all windows with two hashes of each)."""
    lower = K.LOWER[data]
    starts, ends = K.spans(K.ALNUM[lower], offsets)
    words = K.span_hashes(lower, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(words))
    # the sizes share their prefixes: a window is hashed from its last word on
    one, two, out = words.copy(), K.mix(words ^ np.uint64(0x5DEECE66D)), {}
    other = two.copy()
    for n in range(1, max(sizes, default=0) + 1):
        if n > 1:
            one[: len(words) - n + 1] = K.pair(one[: len(words) - n + 1], words[n - 1 :])
            two[: len(words) - n + 1] = K.pair(two[: len(words) - n + 1], other[n - 1 :])
        if n in sizes:
            first = np.flatnonzero(left >= n)
            out[n] = (first, one[first], two[first])
    return starts, ends, bounds, out


def _bits(h: np.ndarray, bits: int) -> np.ndarray:
    """The filter's places of each hash."""
    return np.stack([(K.mix(h + np.uint64(k)) % np.uint64(bits)).astype(np.int64) for k in range(3)])


WINDOWS = [T.StructField("size", T.IntegerType()), T.StructField("one", T.LongType()), T.StructField("two", T.LongType())]
HITS = "text_one long, text_two long, size int, one long, two long, first_word long, end_word long, start_byte long, end_byte long"


def _join(docs: DataFrame, every: DataFrame, text: str, names: tuple[str, str, str], id_type: T.DataType, bits: int) -> DataFrame:
    """``docs`` with the hits of ``every`` (window, ids), by a join of window hashes."""

    def of_windows(batches):
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(0)):
                sizes = np.diff(np.searchsorted(K.spans(K.ALNUM[K.LOWER[data]], offsets)[0], offsets))
                found = _hashes(data, offsets, np.unique(sizes).tolist())[3]
                first = np.cumsum(sizes) - sizes
                h = np.zeros((2, hi - lo), np.uint64)
                for n, (at, one, two) in found.items():
                    own = np.flatnonzero(sizes == n)
                    place = np.searchsorted(at, first[own])
                    h[0][own], h[1][own] = one[place], two[place]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(sizes.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in h)], names=["window", "ids", *(f.name for f in WINDOWS)])

    keyed = every.mapInArrow(K.task(of_windows), T.StructType([*every.schema.fields, *WINDOWS])).drop("window")

    def places(batches):
        for batch in batches:
            at = _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["at", "mask"])

    # at most bits / 64 rows, whatever the benchmark's size
    cells = keyed.select("one").mapInArrow(K.task(places), "at long, mask long").groupBy("at").agg(F.expr("bit_or(mask)").alias("mask")).toPandas()
    table = np.zeros(bits >> 6, np.uint64)
    table[cells["at"].to_numpy(np.int64)] = cells["mask"].to_numpy(np.int64).view(np.uint64)
    lengths = sorted(r[0] for r in keyed.select("size").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast((table, lengths))

    def hits(batches):
        table, lengths = shared.value
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(0)):
                starts, ends, bounds, found = _hashes(data, offsets, lengths)
                for n, (first, one, two) in found.items():
                    some = np.ones(len(first), bool)
                    for at in _bits(one, bits):
                        some &= (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                    first, one, two = first[some], one[some], two[some]
                    if not len(first):
                        continue
                    d = np.searchsorted(bounds, first, "right") - 1
                    rows = pa.array(d + lo)
                    longs = [first - bounds[d], first + n - bounds[d], starts[first] - offsets[d], ends[first + n - 1] - offsets[d]]
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(rows), batch.column(2).take(rows), pa.array(np.full(len(first), n, np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *map(pa.array, longs)], names=[f.split()[0] for f in HITS.split(", ")])

    # rows with one text have one result, so texts are the keys
    seeded = lambda k: F.xxhash64(F.lit(k), F.col(text))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(text), seeded(1).alias("a"), seeded(2).alias("b"))
    raw = texts.mapInArrow(K.task(hits), HITS)
    span = F.struct("first_word", "end_word", "start_byte", "end_byte")
    ids, spans = fresh(docs, "hit_ids"), fresh(docs, "hit_places")
    by_text = raw.join(keyed, ["size", "one", "two"]).groupBy("text_one", "text_two").agg(F.collect_set(span).alias(spans), F.collect_set("ids").alias(ids))
    merged = F.aggregate(F.array_sort(F.col(spans)), F.lit(None).cast(T.ArrayType(SPAN, False)), _absorb)
    one, two = fresh(docs, "hit_one"), fresh(docs, "hit_two")
    found = by_text.select(F.col("text_one").alias(one), F.col("text_two").alias(two), merged.alias(names[1]), F.array_sort(F.array_distinct(F.flatten(ids))).alias(names[2]))
    words = F.filter(F.split(_lower(text), SEPARATORS), lambda w: w != "")
    out = docs.withColumn(names[0], F.coalesce(F.size(words).cast("long"), F.lit(0).cast("long"))).withColumn(names[0], F.greatest(F.col(names[0]), F.lit(0).cast("long")))
    # both sides are dealt anew, so that a text of very many documents can be split
    joined = out.join(found, (F.bitwise_not(seeded(1)) == F.bitwise_not(one)) & (F.bitwise_not(seeded(2)) == F.bitwise_not(two)), "left").drop(one, two)
    none = lambda t: F.array().cast(t)
    return joined.withColumn(names[1], F.coalesce(names[1], none(T.ArrayType(SPAN, False)))).withColumn(names[2], F.coalesce(names[2], none(T.ArrayType(id_type))))


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES, filter_bits: int = FILTER_BITS, names: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items")) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (disjoint spans of hit words, in
    words and in bytes of the original text) and ``hit_items``, or other
    ``names``.  The bytes of all windows are counted first: an automaton scans
    the texts while they are at most ``automaton_bytes``, a join is made beyond."""
    names = tuple(fresh(docs, n) for n in names)
    id_type = items.schema[item_id].dataType
    if id_type.simpleString() not in ("bigint", "int", "string"):
        items, id_type = items.withColumn(item_id, F.col(item_id).cast("string")), T.StringType()
    every = windows(items, item_id, item_text, size).groupBy("window").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    total = every.agg(F.sum(F.octet_length("window") + 8 * F.size("ids"))).first()[0] or 0
    if total > automaton_bytes:
        return _join(docs, every, text, names, id_type, filter_bits)
    patterns = [(r[0].encode().decode("latin-1"), list(r[1])) for r in every.collect()]
    return _scan(docs, text, patterns, names, id_type)


def _absorb(found, s):
    """``found`` (or null) with span ``s``, which begins no earlier than its last one."""
    last = F.element_at(found, -1)
    joined = F.struct(
        last.first_word.alias("first_word"),
        F.greatest(last.end_word, s.end_word).alias("end_word"),
        last.start_byte.alias("start_byte"),
        F.greatest(last.end_byte, s.end_byte).alias("end_byte"),
    )
    return F.when(found.isNull(), F.array(s)).when(last.end_word >= s.first_word, F.concat(F.slice(found, 1, F.size(found) - 1), F.array(joined))).otherwise(F.concat(found, F.array(s)))


def n_hit(spans: str = "hit_spans"):
    """The number of hit words."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s.end_word - s.first_word)


def contaminated(n_words: str = "n_words", spans: str = "hit_spans", share: int = 20):
    """At least one hit word, and one in ``share`` of all words."""
    hit = n_hit(spans)
    return (hit > 0) & (share * hit >= F.col(n_words))
