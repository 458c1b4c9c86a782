"""Prefix trie of conversations: a Cartesian tree over the LCP array of the
sorted conversations.

A turn is a digest of 16 bytes and the length of its text; a conversation is
the string of its digests.  All are sorted by one range partitioning over
(string, id), so that thousands of equal conversations spread over partitions.
A partition is a block: it holds the conversations, and each one's longest
common prefix (LCP) with the one before it.

A trie node where conversations part or end is an interval of the order, between
the nearest smaller LCPs on either side of a place.  Each block finds them with
one stack; places of equal LCP between the same smaller ones are one node.  A
node that reaches beyond its block looks up, in the array of block minima, the
nearest block with a smaller LCP, and meets by an equality join the one of that
block's prefix or suffix minima that ends it.  Pieces of one node from several
blocks are merged by a group-by.  Then the depths between a node and its parent,
where nobody parts or ends, are filled in; they have their node's interval.

All numbers of a node come from its interval [l, r]: members are r - l + 1,
leaves a difference of prefix sums, and the bytes that its subtree saves are
sum(shared bytes of neighbours in (l, r]) - (r - l) * (bytes above the node).

The driver gets five numbers a block.  A task holds one block, about ``BLOCK``
bytes of digests and lengths (24 a turn), or one conversation if that is longer.
Ids of conversations that end at one node are contiguous; each block packs its
own, and those of a node of many blocks pass in order through one SHA-256, which
holds one block's at a time.

Defined results: rows without a conversation id are left out; a null role or
text is empty; turns in order of their number, null first, then of their digest
(so repeated rows are turns of their own and ties have one order); other columns
are not read; an empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .shared import drop, parts, written

#: Bytes of a turn's digest.
WIDTH = 16
#: Bytes of digests and lengths in a block, about.
BLOCK = 16 << 20
#: More than any LCP.
TOP = 1 << 40


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (digest, size)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t.digest.alias("digest"), t.size.alias("size"))).alias("turns"))


def rebuilt(convs: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % group
    for its own first h; h = crc32(c) % most."""
    h = F.expr(f"cast(crc32(cast(conv_id as string)) % {most} as int)")
    heads = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most - 1).alias("head"))
    out = convs.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("head_id"), "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(0)))
    return out.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), own)).alias("turns"))


def common_units(a: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many of up to ``most`` units are equal, of the rows of ``a`` from
    ``a_at`` and from ``b_at`` on."""
    out = most.copy()
    some = np.flatnonzero(most > 0)
    if len(some):
        size = most[some]
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        same = (a[K.ranges(a_at[some], size)] == a[K.ranges(b_at[some], size)]).all(1)
        out[some] = np.minimum.reduceat(np.where(same, TOP, step), first).clip(max=size)
    return out


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.buffers(column)
    return np.frombuffer(data.tobytes(), np.uint64).reshape(-1, WIDTH // 8), offsets // WIDTH


def _cumulated(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each row's values up to each place, from 0 on, and where rows begin."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.int64)[: offsets[-1]]
    total = np.concatenate(([0], np.cumsum(values)))
    lengths = np.diff(offsets)
    at = np.repeat(offsets[:-1], lengths + 1)
    return total[K.ranges(offsets[:-1], lengths + 1)] - total[at], offsets[:-1] - offsets[0] + np.arange(len(lengths))


def ordered(convs: DataFrame, blocks: int) -> DataFrame:
    """Sorted conversations with their block, place in it, length, and what they
    share with the one before (first of a block: nothing yet)."""
    wide = convs.select(F.unhex(F.array_join("turns.digest", "")).alias("seq"), "conv_id", F.col("turns.size").alias("sizes"))

    def run(batches):
        before, place = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            seqs = batch.column("seq")
            joined = seqs if before is None else pa.concat_arrays([before, seqs])
            units, at = _units(joined)
            lengths = np.diff(at)
            lcp = np.concatenate(([-1], common_units(units, at[1:-1], at[:-2], np.minimum(lengths[1:], lengths[:-1]))))
            ended = np.concatenate(([0], lcp[1:] < lengths[:-1])).astype(np.int64)  # the one before is a leaf
            if before is not None:
                lcp, ended, lengths = lcp[1:], ended[1:], lengths[1:]
            sums, first = _cumulated(batch.column("sizes"))
            shared = sums[first + np.maximum(lcp, 0)]
            found = (pa.array(x, pa.int64()) for x in (np.arange(place, place + n), lengths, lcp, shared, ended))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=["seq", "conv_id", "sizes", "place", "length", "lcp", "shared", "ended"])
            before, place = seqs.slice(n - 1), place + n

    rows = wide.repartitionByRange(blocks, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    return rows.mapInArrow(K.task(run), "seq binary, conv_id long, sizes array<long>, place long, length long, lcp long, shared long, ended long").withColumn("block", F.spark_partition_id().cast("long"))


@dataclass(frozen=True)
class Blocks:
    """What every block knows of all: a few numbers each, in order."""

    ids: np.ndarray
    starts: np.ndarray  # place of the first conversation, and the total at the end
    lcp: np.ndarray  # of the first conversation with the block before; -1 at either end
    shared: np.ndarray  # bytes of that
    low: np.ndarray  # least LCP
    least: np.ndarray  # least id
    shares: np.ndarray  # sum of shared bytes of the blocks before
    leaves: np.ndarray  # leaves among the conversations before

    def near(self, block: int, lcp: int, step: int) -> tuple[int, int]:
        """The nearest block with a smaller LCP before or behind (``step``) and
        the least id of the blocks between; beyond the last: their number."""
        at, least = block + step, TOP << 20
        while 0 <= at < len(self.ids) and self.low[at] >= lcp:
            least = min(least, int(self.least[at]))
            at += step
        return at, least


def summary(rows: DataFrame) -> Blocks:
    """One small row of each block, to the driver."""
    stats = rows.groupBy("block").agg(F.count("*").alias("n"), F.min(F.when(F.col("place") > 0, F.col("lcp"))).alias("low"), F.min("conv_id").alias("least"), F.sum("shared").alias("shared"), F.sum("ended").alias("ended"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.min_by("sizes", "place").alias("sizes"))
    stats = stats.withColumn("before", F.lag("last").over(Window.orderBy("block")))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, b = r["before"] or b"", r["first"]
                units, at = _units(pa.array([a, b], pa.binary()))
                lcp = int(common_units(units, at[1:2], at[:1], np.array([min(len(a), len(b)) // WIDTH]))[0])
                shared = sum(r["sizes"][:lcp])
                if r["before"] is None:
                    lcp, shared = -1, 0
                row = {k: r[k] for k in ("block", "n", "low", "least", "shared", "ended")} | {"lcp": lcp, "bytes": shared, "leaf": int(lcp < len(a) // WIDTH)}
                yield pa.RecordBatch.from_pylist([row], pa.schema([(k, pa.int64()) for k in row]))

    found = stats.mapInArrow(run, "block long, n long, low long, least long, shared long, ended long, lcp long, bytes long, leaf long").toPandas().sort_values("block")
    lcp = found.lcp.to_numpy()
    low = np.minimum(np.where(found.low.isna(), TOP, found.low.fillna(0)).astype(np.int64), lcp)
    sums = lambda x: np.concatenate(([0], np.cumsum(x)))
    shares = sums(found.shared.to_numpy() + found.bytes.to_numpy())
    # a block's first row says whether the last of the block before is a leaf
    leaves = sums(found.ended.to_numpy() + np.append(found.leaf.to_numpy()[1:], 1 if len(found) else []).astype(np.int64))
    return Blocks(found.block.to_numpy(), sums(found.n.to_numpy()), np.append(lcp, -1), found.bytes.to_numpy(), low, found.least.to_numpy(), shares, leaves)


class Block:
    """The nodes of one block, by one stack over its LCPs."""

    def __init__(self, table: pa.Table, all_blocks: Blocks):
        table = table.sort_by("place").combine_chunks()
        self.all, self.index = all_blocks, int(np.searchsorted(all_blocks.ids, table["block"][0].as_py()))
        b = self.index
        self.base, self.n = int(all_blocks.starts[b]), table.num_rows
        column = lambda name: table[name].to_numpy().astype(np.int64)
        self.conv, self.length, lcp, shared, ended = map(column, ("conv_id", "length", "lcp", "shared", "ended"))
        lcp[0], shared[0] = all_blocks.lcp[b], all_blocks.shared[b]
        self.lcp = np.append(lcp, all_blocks.lcp[b + 1])
        self.shares = np.cumsum(shared) + all_blocks.shares[b]  # up to and with each place
        leaf = np.append(ended[1:], int(self.lcp[self.n] < self.length[-1]))
        self.leaves = np.concatenate(([0], np.cumsum(leaf))) + all_blocks.leaves[b]  # before each place
        self.cum, self.cum_at = _cumulated(table["sizes"].combine_chunks())
        self._nodes()

    def _nodes(self) -> None:
        """value, first place, left end, right end (-1: beyond the block), least
        id and parent of every node; ``node``: that of each place."""
        lcp, conv, n = self.lcp.tolist(), self.conv.tolist(), self.n
        value, rep, left, right, least, parent = [], [], [], [], [], []
        node, stack = [-1] * n, []
        for i in range(n + 1):
            v, low, start, over = lcp[i], conv[i - 1] if i else TOP << 20, i - 1, []
            while stack and value[stack[-1]] > v:
                k = stack.pop()
                low = least[k] = min(least[k], low)
                right[k], start = i - 1, left[k]
                if over:
                    parent[over.pop()] = k
                over.append(k)
            if i == n:
                if over:  # its parent is below it here or begins the next block
                    parent[over[0]] = stack[-1] if stack and value[stack[-1]] >= v else -2
                for k in reversed(stack):
                    low = least[k] = min(least[k], low)
                break
            if not stack or value[stack[-1]] < v:
                k = len(value)
                for some, x in ((value, v), (rep, i), (left, start), (right, -1), (least, low), (parent, stack[-1] if stack else -1)):
                    some.append(x)
                stack.append(k)
            else:
                k = stack[-1]
                least[k] = min(least[k], low)
            if over:
                parent[over[0]] = k
            node[i] = k
        self.node = np.array(node)
        self.value, self.rep, self.left, self.right, self.least, self.parent = (np.array(x, np.int64) for x in (value, rep, left, right, least, parent))
        self.closed = (self.left >= 0) & (self.right >= 0) & (self.value >= 0)
        self.parting = np.bincount(self.node, minlength=len(value))
        self.ending = np.bincount(self.node, weights=self.length == self.lcp[:n], minlength=len(value)).astype(np.int64)

    def _above(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(LCP, least id if closed, else place to look it up) of parents; -2 is
        the first node of the next block, -1 is none."""
        k = np.maximum(node, 0)
        lcp = np.where(node >= 0, self.value[k], np.where(node == -2, self.lcp[self.n], -1))
        known = (node >= 0) & self.closed[k]
        at = np.where(node == -2, self.base + self.n, self.base + self.rep[k])
        return lcp, np.where(known, self.least[k], -1), np.where(known | (lcp < 0), -1, at)

    def _expanded(self, ids, lows, tops, above, convs, leaves, last_children, spans, shares, member, ends) -> pa.Table:
        """A row for each depth in (low, top] of some nodes."""
        size = tops - lows
        which = np.repeat(np.arange(len(ids)), size)
        depth = K.ranges(lows + 1, size)
        first, last = depth == lows[which] + 1, depth == tops[which]
        _, known, at = above
        up = np.where(first, known[which], ids[which])
        ref = np.where(first, at[which], -1)
        parentless = (depth == 0) | (ref >= 0)
        over = np.where(depth > 0, self.cum[self.cum_at[member[which]] + np.maximum(depth - 1, 0)], 0)
        texts = np.where(last, which, len(ends))
        columns = {
            "kind": pa.array(["node"]).take(pa.array(np.zeros(len(which), np.int64))),
            "conv_id": ids[which],
            "depth": depth,
            "parent_conv_id": pa.array(up, mask=parentless),
            "parent_at": pa.array(ref, mask=ref < 0),
            "n_convs": convs[which],
            "n_children": np.where(last, last_children[which], 1),
            "n_leaves": leaves[which],
            "saved_tokens": shares[which] - spans[which] * over,
            "ends": pa.array([*ends, ""], pa.string()).take(pa.array(texts)),
        }
        return pa.table(columns)

    def _ids(self, places: np.ndarray) -> str:
        return ",".join(map(str, self.conv[places].tolist()))

    def closed_nodes(self) -> pa.Table:
        some = np.flatnonzero(self.closed)
        l, r, v = self.left[some], self.right[some], self.value[some]
        first = self.length[l] == v
        ending = self.ending[some] + first
        # those that end at a node stand first in it
        ends = [self._ids(np.arange(a, a + e)) for a, e in zip(l, ending, strict=True)]
        above = self._above(self.parent[some])
        return self._expanded(self.least[some], above[0], v, above, r - l + 1, self.leaves[r + 1] - self.leaves[l], self.parting[some] + 1 - ending, r - l, self.shares[r] - self.shares[l], l, ends)

    def single(self) -> pa.Table:
        """Conversations that go on alone."""
        n = self.n
        m = np.maximum(self.lcp[:n], self.lcp[1:])
        some = np.flatnonzero(self.length > m)
        behind = self.lcp[some + 1] > self.lcp[some]
        node = np.where(behind, np.append(self.node, -2)[some + 1], self.node[some])
        node = np.where(m[some] < 0, -1, node)
        none, one = np.zeros(len(some), np.int64), np.ones(len(some), np.int64)
        return self._expanded(self.conv[some], m[some], self.length[some], self._above(node), one, one, none, none, none, some, list(map(str, self.conv[some].tolist())))

    def _left(self, p: int) -> list[int]:
        """Of the left end p of a node: place, shared bytes and leaves up to it,
        LCP and place of its node, length and id of its conversation."""
        return [self.base + p, int(self.shares[p]), int(self.leaves[p]), int(self.lcp[p]), self.base + int(self.rep[self.node[p]]), int(self.length[p]), int(self.conv[p])]

    def _right(self, p: int) -> list[int]:
        """Of the place p behind a node: the same of the last one in it."""
        shares = self.shares[p - 1] if p else self.all.shares[self.index]
        at = self.base + (int(self.rep[self.node[p]]) if p < self.n else self.n)
        return [self.base + p - 1, int(shares), int(self.leaves[p]), int(self.lcp[p]), at]

    def pieces(self) -> pa.Table:
        """Nodes that reach beyond the block, as far as they stand in it."""
        out = []
        order = np.argsort(self.node, kind="stable")
        bounds = np.searchsorted(self.node[order], np.arange(len(self.value) + 1))
        for k in np.flatnonzero(~self.closed & (self.value >= 0)).tolist():
            v, least = int(self.value[k]), int(self.least[k])
            places = order[bounds[k] : bounds[k + 1]]
            row = {"kind": "piece", "at": self.base + int(self.rep[k]), "lcp": v, "block": self.index, "n_children": len(places), "n_convs": int(self.ending[k])}
            row["ends"] = self._ids(places[self.length[places] == v])
            start = self.cum_at[self.rep[k]]
            row["cum"] = self.cum[start : start + v + 1].tolist()
            if self.left[k] >= 0:
                row["left"] = self._left(int(self.left[k]))
            else:
                row["left_block"], low = self.all.near(self.index, v, -1)
                least = min(least, low)
            if self.right[k] >= 0:
                row["right"] = self._right(int(self.right[k]) + 1)
            else:
                row["right_block"], low = self.all.near(self.index, v, 1)
                least = min(least, low)
                if row["right_block"] == len(self.all.ids):
                    row["right"] = [int(x[-1]) - y for x, y in ((self.all.starts, 1), (self.all.shares, 0), (self.all.leaves, 0))] + [-1, -1]
            out.append({**row, "conv_id": least})
        return out

    def edges(self) -> list[dict]:
        """The strict prefix and suffix minima of the block's LCPs."""
        lcp, out = self.lcp[: self.n], []
        low = np.minimum.accumulate(lcp)
        least = np.concatenate(([TOP << 20], np.minimum.accumulate(self.conv)))
        for p in np.flatnonzero(np.concatenate(([True], low[1:] < low[:-1]))).tolist():
            out.append({"kind": "edge", "block": self.index, "side": 1, "lcp": int(lcp[p]), "upto": int(low[p - 1]) if p else TOP, "edge": self._right(p), "conv_id": int(least[p])})
        low = np.minimum.accumulate(lcp[::-1])[::-1]
        least = np.minimum.accumulate(self.conv[::-1])[::-1]
        for p in np.flatnonzero(np.concatenate((low[:-1] < low[1:], [True]))).tolist():
            out.append({"kind": "edge", "block": self.index, "side": -1, "lcp": int(lcp[p]), "upto": int(low[p + 1]) if p + 1 < self.n else TOP, "edge": self._left(p), "conv_id": int(least[p])})
        return out


#: SCHEMA in Arrow's terms.
_INTEGERS = "conv_id depth parent_conv_id parent_at n_convs n_children n_leaves saved_tokens at lcp block left_block right_block upto side"
ARROW = pa.schema([("kind", pa.string()), ("ends", pa.string()), *((c, pa.int64()) for c in _INTEGERS.split()), *((c, pa.list_(pa.int64())) for c in "cum left right edge".split())])
SCHEMA = "kind string, ends string, " + ", ".join(f"{c} long" for c in _INTEGERS.split()) + ", cum array<long>, left array<long>, right array<long>, edge array<long>"


def block_nodes(rows: DataFrame, all_blocks: Blocks) -> DataFrame:
    """All blocks' whole nodes, pieces of nodes, and edges for pieces to meet."""

    def run(table: pa.Table) -> pa.Table:
        block = Block(table, all_blocks)
        small = pa.Table.from_pylist([*block.pieces(), *block.edges()], ARROW)
        whole = [pa.table({f.name: t[f.name].cast(f.type) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in ARROW}) for t in (block.closed_nodes(), block.single())]
        return pa.concat_tables([*(t.cast(ARROW) for t in whole), small])

    return rows.select("block", "place", "conv_id", "sizes", "length", "lcp", "shared", "ended").groupBy("block").applyInArrow(run, SCHEMA)


def met(pieces: DataFrame, edges: DataFrame) -> DataFrame:
    """Pieces with both ends of their nodes."""
    for side, name in ((-1, "left"), (1, "right")):
        edge = edges.where(F.col("side") == side).select(F.col("block").alias("b"), F.col("lcp").alias("below"), F.col("upto").alias("most"), F.col("edge").alias("e"), F.col("conv_id").alias("c"))
        found = (F.col(f"{name}_block") == F.col("b")) & (F.col("below") < F.col("lcp")) & (F.col("lcp") <= F.col("most"))
        pieces = pieces.join(edge, found, "left").withColumn(name, F.coalesce(name, "e")).withColumn("conv_id", F.least("conv_id", "c")).drop("b", "below", "most", "e", "c")
    return pieces.withColumn("l", F.col("left")[0])


def digests(chunks: DataFrame) -> DataFrame:
    """(l, lcp, digest) of the texts of each (l, lcp), joined by commas in order of ``block``."""

    def run(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for l, lcp, _, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now == (l, lcp):
                    state.update(f",{ends}".encode())
                else:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = (l, lcp), hashlib.sha256(ends.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("l", "lcp", "digest"), d, strict=True)) for d in done], _DIGEST)
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(("l", "lcp", "digest"), (*now, state.hexdigest()), strict=True))], _DIGEST)

    # a node's ids are hashed in order, so by one task; it holds one chunk at a time
    dealt = chunks.select("l", "lcp", "block", "ends").repartition("l", "lcp").sortWithinPartitions("l", "lcp", "block")
    return dealt.mapInArrow(run, "l long, lcp long, digest string")


_DIGEST = pa.schema([("l", pa.int64()), ("lcp", pa.int64()), ("digest", pa.string())])


def trie(convs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Every node of the prefix trie of (conv_id, turns): conv_id (least member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 of those that end there."""
    rows = written(ordered(convs, blocks or parts(convs.sparkSession, convs, BLOCK)), "trie-order")
    found = written(block_nodes(rows, summary(rows)), "trie-blocks")
    drop(rows)
    pieces = written(met(found.where("kind = 'piece'"), found.where("kind = 'edge'")), "trie-pieces")
    first = lambda c: F.first(c).alias(c)  # noqa: E731 (equal in all pieces of a node)
    merged = pieces.groupBy("l", "lcp").agg(F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("parting"), F.sum("n_convs").alias("ending"), first("left"), first("right"), first("cum"))
    nodes = written(merged.withColumn("head", (F.col("left")[5] == F.col("lcp")).cast("long")), "trie-nodes")
    spots = pieces.select("at", "l", "lcp").join(nodes.select("l", "lcp", F.col("conv_id").alias("spot_conv_id")), ["l", "lcp"]).select("at", "spot_conv_id")
    heads = nodes.where("head = 1").select("l", "lcp", F.lit(-1).cast("long").alias("block"), F.col("left")[6].cast("string").alias("ends"))
    ends = digests(pieces.where("ends <> ''").select("l", "lcp", "block", "ends").unionByName(heads))
    low = F.greatest(F.col("left")[3], F.col("right")[3])
    above = F.when(low >= 0, F.when(F.col("left")[3] >= F.col("right")[3], F.col("left")[4]).otherwise(F.col("right")[4]))
    empty = F.sha2(F.lit(""), 256)
    top, is_top = F.col("depth") == F.col("low") + 1, F.col("depth") == F.col("lcp")
    ending = F.col("ending") + F.col("head")
    spread = nodes.join(ends, ["l", "lcp"], "left").withColumn("low", low).withColumn("above", above).withColumn("depth", F.explode(F.sequence(F.col("low") + 1, "lcp")))
    over = F.when(F.col("depth") > 0, F.element_at("cum", F.col("depth").cast("int"))).otherwise(0)
    wide = spread.select(
        "conv_id",
        "depth",
        F.when(~top, F.col("conv_id")).alias("parent_conv_id"),
        F.when(top, F.col("above")).alias("parent_at"),
        (F.col("right")[0] - F.col("l") + 1).alias("n_convs"),
        F.when(is_top, F.col("parting") + 1 - ending).otherwise(1).alias("n_children"),
        (F.col("right")[2] - F.col("left")[2]).alias("n_leaves"),
        (F.col("right")[1] - F.col("left")[1] - (F.col("right")[0] - F.col("l")) * over).alias("saved_tokens"),
        F.when(is_top, F.coalesce("digest", empty)).otherwise(empty).alias("ends_sha256"),
    )
    whole = found.where("kind = 'node'").select("conv_id", "depth", "parent_conv_id", "parent_at", "n_convs", "n_children", "n_leaves", "saved_tokens", F.sha2("ends", 256).alias("ends_sha256"))
    out = whole.unionByName(wide).join(spots.withColumnRenamed("at", "parent_at"), "parent_at", "left")
    return out.select("conv_id", "depth", F.coalesce("parent_conv_id", "spot_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_nodes(df: DataFrame, group: int = 5, most: int = 9, blocks: int | None = None) -> DataFrame:
    """The trie of all conversations of (conv_id, turn, role, text), rebuilt."""
    return trie(written(rebuilt(written(turns(df), "trie-turns"), group, most), "trie-rebuilt"), blocks)
