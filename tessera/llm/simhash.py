"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments.  Of two fingerprints that
differ in at most 4 (at most 5) bits, some segment differs in at most one; so
both share a variant of it with that one bit left out.  Each distinct
fingerprint is indexed under its 64 variants (one wildcard bit each) and equal
variants meet in one bucket, where full fingerprints are compared.

Copies share a fingerprint and are collapsed first.  A bucket reports a
spanning forest of its links, not all pairs; a large bucket is cut once more by
the same rule over the bits that its key leaves open, so no bucket is capped.

Defined results: null and empty texts (no words) have fingerprint zero and link
like any other; fewer words than a shingle give one shingle of all words;
repeated rows are all returned; rows with a null ``doc_id`` get the smallest id
of their component, null if it has none.  Other columns may have any names.  A
very long text is held whole by one task, with some 150 bytes a word.  An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.skew import dealt_join

from . import kernels as K
from .components import connected_components
from .shared import drop, fresh, parts, written

SHINGLE = 4
DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A bucket of more fingerprints is cut again.
DIRECT = 1024

# fixed values of the XXH64 definition
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 42


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte spans at once."""
    n = len(data)
    padded = np.zeros((n // 8 + 3) * 8, np.uint8)
    padded[:n] = data
    at = np.empty(len(padded) - 8, np.uint64)  # the 8 bytes from each place
    for k in range(8):
        own = at[k::8]
        own[:] = np.frombuffer(padded, "<u8", len(own), k)
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(starts), s + P5, np.uint64)
        place = starts.astype(np.int64).copy()
        stripes = lengths // 32
        some = np.flatnonzero(stripes)
        if len(some):
            acc = [np.full(len(some), v, np.uint64) for v in (s + P1 + P2, s + P2, s, s - P1)]
            left, where = stripes[some], place[some]
            live = np.arange(len(some))
            while len(live):
                for k in range(4):
                    acc[k][live] = _round(acc[k][live], at[where[live] + 8 * k])
                where[live] += 32
                left[live] -= 1
                live = live[left[live] > 0]
            x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for k in range(4):
                x = (x ^ _round(np.zeros_like(acc[k]), acc[k])) * P1 + P4
            h[some] = x
            place[some] = where
        h += lengths.astype(np.uint64)
        rest = lengths % 32
        for k in range(3):
            some = np.flatnonzero(rest >= 8 * (k + 1))
            h[some] = _rotl(h[some] ^ _round(np.zeros(len(some), np.uint64), at[place[some]]), 27) * P1 + P4
            place[some] += 8
        some = np.flatnonzero(rest % 8 >= 4)
        h[some] = _rotl(h[some] ^ ((at[place[some]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        place[some] += 4
        for k in range(3):
            some = np.flatnonzero(rest % 4 > k)
            h[some] = _rotl(h[some] ^ ((at[place[some]] & np.uint64(0xFF)) * P5), 11) * P1
            place[some] += 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h


#: Spreads the bits of a byte over the 8 bytes of a word.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the 64 majority bits of its ``counts`` hashes; zero for none."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    blocks = -(-counts[some] // 255)  # lanes of 8 bits hold sums of 255 at most
    first = np.cumsum(counts[some]) - counts[some]
    block_at = np.repeat(first, blocks) + 255 * K.ranges(np.zeros(len(some), np.int64), blocks)
    text_at = np.cumsum(blocks) - blocks
    lanes = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[lanes[:, k]], block_at)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), text_at, axis=0)
        bits = (2 * ones > counts[some][:, None]).astype(np.uint64)
        out[some] |= (bits << (np.arange(8, dtype=np.uint64) + np.uint64(8 * k))).sum(axis=1, dtype=np.uint64)
    return out


def chunk_fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Fingerprints of a chunk of texts."""
    starts, ends = K.spans(K.GRAPHIC[data], offsets)
    lengths = ends - starts
    begin = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    joined[K.ranges(begin, lengths)] = K.LOWER[data[K.ranges(starts, lengths)]]
    first = np.searchsorted(starts, offsets)
    words = np.diff(first)
    shingles = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    a = K.ranges(first[:-1], shingles)
    b = a + np.repeat(np.minimum(words, size), shingles) - 1
    h = xxh64(joined, begin[a], begin[b] + lengths[b] - begin[a])
    return majority(h, shingles)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", keep_text: bool = True, size: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint as a 64-bit integer (two's complement)."""
    out = fresh(df, out)
    at = df.columns.index(text)
    schema = T.StructType([*(f for f in df.schema.fields if keep_text or f.name != text), T.StructField(out, T.LongType())])
    names = schema.names

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(at)):
                columns = [c for i, c in enumerate(batch.slice(lo, hi - lo).columns) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(chunk_fingerprints(data, offsets, size).view(np.int64))], names=names)

    return df.mapInArrow(K.task(run), schema)


def variants(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """(key, fp): the 64 one-wildcard segment variants of each fingerprint.  A
    key holds the wildcard's place and the segment without that bit."""
    j = F.explode(F.sequence(F.lit(0), F.lit(63)))
    begin = F.when(F.col("j") < SEGMENTS[1][0], F.lit(0)).when(F.col("j") < SEGMENTS[2][0], F.lit(SEGMENTS[1][0])).otherwise(F.lit(SEGMENTS[2][0]))
    width = F.when(F.col("j") < SEGMENTS[1][0], F.lit(SEGMENTS[0][1])).otherwise(F.lit(SEGMENTS[1][1]))
    rows = prints.select(fp, j.alias("j"))
    segment = F.expr(f"shiftrightunsigned(`{fp}`, begin)").bitwiseAND(F.expr("shiftleft(1L, width) - 1"))
    key = segment.bitwiseAND(F.expr("~shiftleft(1L, j - begin)")) + F.col("j").cast("long") * (1 << 22)
    return rows.withColumn("begin", begin).withColumn("width", width).select(key.alias("key"), F.col(fp).alias("fp"))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that pairs (i, j) connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_bucket(fps: np.ndarray, free: tuple[int, ...], distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of indices, of the links among distinct
    fingerprints that agree outside the bits ``free`` but for one wildcard."""
    n = len(fps)
    if n <= DIRECT or len(free) < 9:
        label = np.arange(n)
        step = max(1, (1 << 20) // n)
        for lo in range(0, n, step):
            near = np.bitwise_count(fps[lo : lo + step, None] ^ fps[None, :]) <= distance
            i, j = np.nonzero(near)
            label = forest(np.concatenate((i + lo, label)), np.concatenate((j, np.arange(n))), n)
        child = np.flatnonzero(label != np.arange(n))
        return child, label[child]
    # the rule again, over the open bits: some third of them differs in at most one
    third = -(-len(free) // 3)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(free), third):
        own = free[s : s + third]
        rest = tuple(b for b in free if b not in own)
        mask = np.uint64(sum(1 << b for b in own))
        for b in own:
            key = fps & mask & ~np.uint64(1 << b)
            order = np.argsort(key, kind="stable")
            edges = np.append(K.runs(key[order]), n)
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if y - x > 1:
                    group = order[x:y]
                    i, j = link_bucket(fps[group], rest, distance)
                    out.append((group[i], group[j]))
    i, j = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
    label = forest(i, j, n)
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _bucket_links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in sorted runs of equal keys: short runs side by side, long ones each."""
    first = K.runs(keys)
    sizes = np.diff(np.append(first, len(keys)))
    out = []
    small = np.repeat(sizes, sizes) <= 16
    for shift in range(1, 16):
        if shift >= len(keys):
            break
        same = np.flatnonzero((keys[shift:] == keys[:-shift]) & small[shift:])
        if not len(same):
            break
        near = np.bitwise_count(fps[same] ^ fps[same + shift]) <= distance
        out.append((fps[same[near]], fps[same[near] + shift]))
    for k in np.flatnonzero(sizes > 16).tolist():
        group = fps[first[k] : first[k] + sizes[k]]
        begin, width = next((s, w) for s, w in SEGMENTS if s <= int(keys[first[k]]) >> 22 < s + w)
        i, j = link_bucket(group, tuple(b for b in range(64) if not begin <= b < begin + width), distance)
        out.append((group[i], group[j]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def links(prints: DataFrame, fp: str = "fp", distance: int = DISTANCE) -> DataFrame:
    """(u, v): links between distinct fingerprints that connect what any link does."""
    if not 0 <= distance <= 5:
        raise ValueError("three segments with one wildcard find up to 5 differing bits")
    keyed = variants(prints, fp)
    n = parts(prints.sparkSession)

    def run(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last run may go on
            yield from emit(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
        yield from emit(keys, fps)

    def emit(keys, fps):
        if len(keys):
            u, v = _bucket_links(keys, fps, distance)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(K.task(run), "u long, v long").distinct()


def components(prints: DataFrame, fp: str = "fingerprint", doc_id: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """(fp, component, component_id): for each distinct fingerprint of the table
    its component (the smallest fingerprint in it) and the smallest ``doc_id``
    whose fingerprint is reachable."""
    nodes = prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least"))
    nodes = written(nodes, "simhash-nodes")
    found = connected_components(links(nodes, "fp", distance), "u", "v", "simhash-components")
    placed = nodes.join(found, nodes.fp == found.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return dealt_join(placed, ids, "component").select("fp", "component", "component_id")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = written(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep_text=False), "simhash-fingerprints")
    found = components(prints, distance=distance)
    return prints.join(found, prints.fingerprint == found.fp).select("doc_id", "fingerprint", "component_id")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of each component of ``df``, columns unchanged: that of the
    smallest ``doc_id`` (null ids last), of equal ids the smallest text hash;
    of rows equal in both any one."""
    place = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))
    prints = written(fingerprints(df.select(place.alias("place"), place["id"].alias("doc_id"), F.col(text).alias("text")), keep_text=False), "simhash-fingerprints")
    found = components(prints, distance=distance)
    kept = prints.join(found, prints.fingerprint == found.fp).groupBy("component").agg(F.min("place").alias("place"))
    own_id, own_hash, key_id, key_hash = (fresh(df, n) for n in ("_own_id", "_own_hash", "_key_id", "_key_hash"))
    # a null id becomes a text no id has, so that it can be joined on
    marked = lambda no_id, i: F.when(no_id, F.lit("-")).otherwise(i.cast("string"))
    keys = kept.select(marked(F.col("place.no_id"), F.col("place.id")).alias(key_id), F.col("place.hash").alias(key_hash))
    rows = df.withColumn(own_id, marked(F.col(doc_id).isNull(), F.col(doc_id))).withColumn(own_hash, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = (F.col(own_id) == F.col(key_id)) & (F.col(own_hash) == F.col(key_hash))
    return rows.join(keys, same, "left_semi").dropDuplicates([own_id, own_hash]).drop(own_id, own_hash)
