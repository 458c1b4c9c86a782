"""Deleted interpolation: a word bigram model mixed by context frequency.

P(w | h) = a_b * c(h, w) / c(h) + u_b * c(w) / N + z_b / (V + 1), where b is the
bucket floor(log2(c(h) + 1)) of the context's frequency.  The weights of each
bucket are learned by expectation-maximisation on events of a held-out fold of
the training texts, under counts from which that fold is deleted; scores use
the counts of all training texts.  A text's events are its words and one end.

Counting is one round trip.  A block of texts (what one task reads, in pieces
of bounded size) sends each distinct word and bigram once, with its counts, to
the partition that owns the key's hash range: combined before the shuffle, so
no key is hot.  That partition adds up and answers each block in its own order.
The block's word stream travels along, meets the answers and becomes one row a
text with the counts of its events.  Keys are 64-bit hashes; columns are packed
arrays under Zstandard, 5 to 6 bytes a distinct key.

Defined results: a null or empty text is one end event; a row whose id is null
counts as training text; repeated rows are texts of their own; with no
training texts every count is zero and the model is uniform.  Ids must be integers
or cast to them; other columns are not read.  A very long text is a block of its
own, held whole by one task, with some 35 bytes a byte of text.  An empty
table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import drop, parts, written

#: A block has about so many bytes of text.
BLOCK_BYTES = 12 << 20
#: Contexts fall in buckets 0 (unseen) to BUCKETS - 1 by the logarithm of their frequency.
BUCKETS = 41
#: EM events are gathered in cells of 1 / GRID of an octave of either estimate.
GRID = 8
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
TRAIN, FOLD, HELD = 0, 1, 2


def _pack(a: np.ndarray) -> bytes:
    """An array of integers as byte planes under Zstandard."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.zeros((a.itemsize, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(raw: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, np.uint64), dtype=np.uint64)


def events(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, an end after each text; events of each text)."""
    lower = K.LOWER[data]
    starts, ends = K.spans(K.GRAPHIC[lower], offsets)
    words = np.searchsorted(starts, offsets)
    return np.insert(K.span_hashes(lower, starts, ends), words[1:], END), np.diff(words) + 1


def _bigrams(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash of each event with the one before it in its text."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(sizes) - sizes] = BEGIN
    return K.pair(before, words)


def _by_frequency(often: np.ndarray) -> np.ndarray:
    """Places of the words, the most frequent first; equals in order of their keys."""
    return np.argsort(-often.astype(np.int64), kind="stable")


def _count(index: np.ndarray, n: int, which: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(index if which is None else index[which], minlength=n).astype(np.uint32)


SENT = "dest int, block long, kind int, a binary, b binary, c binary, d binary, e binary, f binary"
#: Kinds of rows.
BODY, KEYS, ANSWER, TOTAL = range(4)


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["dest", "block", "kind", *"abcdef"])


def _blocks(n: int):
    """Task body: texts of a partition to block rows for n key ranges."""

    def send(ids, folds, words, sizes, block):
        words, sizes, folds = np.concatenate(words), np.concatenate(sizes), np.concatenate(folds)
        ids = pa.concat_arrays(ids)
        fold = np.repeat(folds, sizes)
        vocabulary, place = np.unique(words, return_inverse=True)
        rows = []
        sides = []
        for keys, index in ((vocabulary, place), np.unique(_bigrams(words, sizes), return_inverse=True)):
            # counts of all training texts, and of the held-out fold among them
            sides.append((keys, _count(index, len(keys), fold != HELD), _count(index, len(keys), fold == FOLD), np.searchsorted(keys, edges)))
        for p in range(n):
            packed = []
            for keys, train, own, cut in sides:
                s = slice(cut[p], cut[p + 1])
                packed += [_pack_keys(keys[s]), _pack(train[s]), _pack(own[s])]
            if sides[0][3][p] < sides[0][3][p + 1] or sides[1][3][p] < sides[1][3][p + 1]:
                rows.append((p, block, KEYS, *packed))
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([ids], names=["id"])
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        often = _count(place, len(vocabulary))
        number = np.empty(len(vocabulary), np.uint32)  # frequent words get small numbers, which pack well
        number[_by_frequency(often)] = np.arange(len(vocabulary), dtype=np.uint32)
        rows.append((block % n, block, BODY, b"", _pack(number[place]), _pack(sizes.astype(np.uint32)), _pack(folds.astype(np.uint8)), sink.getvalue().to_pybytes(), _pack(often)))
        for lo in range(0, len(rows), 64):
            yield _sent(rows[lo : lo + 64])

    edges = np.array([min((p << 64) // n, (1 << 64) - 1) for p in range(n + 1)], np.uint64)

    def run(batches):
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        ids, folds, words, sizes, held = [], [], [], [], 0
        for batch in batches:
            fold = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            for lo, hi, data, offsets in K.chunks(batch.column(1)):
                w, s = events(data, offsets)
                ids.append(batch.column(0).slice(lo, hi - lo))
                folds.append(fold[lo:hi])
                words.append(w)
                sizes.append(s)
                held += len(data) + 1
                if held >= BLOCK_BYTES:
                    yield from send(ids, folds, words, sizes, (task << 24) + k)
                    ids, folds, words, sizes, held, k = [], [], [], [], 0, k + 1
        if ids:
            yield from send(ids, folds, words, sizes, (task << 24) + k)

    return run


def _answers(batches):
    """Task body: adds up the keys of a range and answers every block."""
    own = []
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == BODY:
                yield _sent([tuple(r.values())])
            else:
                own.append(r)
    if not own:
        return
    replies: list[list[bytes]] = [[] for _ in own]
    types_seen = 0
    for side, (k, t, f) in enumerate((("a", "b", "c"), ("d", "e", "f"))):
        keys = [_unpack_keys(r[k]) for r in own]
        every = np.concatenate(keys)
        distinct, index = np.unique(every, return_inverse=True)
        del every
        cut = np.cumsum([0, *map(len, keys)])
        for col in (t, f):
            # exact in the 53 bits of a double: up to 9e15 events
            sums = np.bincount(index, np.concatenate([_unpack(r[col], np.uint32) for r in own]), len(distinct)).astype(np.uint64)
            if side == 0 and col == t:
                types_seen = int(np.count_nonzero(sums))
            for j in range(len(own)):
                replies[j].append(_pack(sums[index[cut[j] : cut[j + 1]]]))
    for r, reply in zip(own, replies, strict=True):
        yield _sent([(r["dest"], r["block"], ANSWER, *reply, r["a"], b"")])
    yield _sent([(own[0]["dest"], -1 - own[0]["dest"], TOTAL, types_seen.to_bytes(8, "little"), b"", b"", b"", b"", b"")])


COUNTED = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("fold", T.IntegerType()), T.StructField("n", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("big", "uni", "big_own", "uni_own"))])


def _planes(a: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Counts as byte planes, for each text as many as the largest count needs."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    a = a.astype("<u8").view(np.uint8).reshape(-1, 8)
    begin, size = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
    at = np.arange(len(a)) + (width - 1) * begin
    out = np.empty(len(a) * width, np.uint8)
    for k in range(width):
        out[at + k * size] = a[:, k]
    return K.binary_column(out, sizes * width)


def _counted(batches):
    """Task body: a block's word stream and all its answers become rows of texts."""

    def close(body, answers):
        answers.sort(key=lambda r: r["dest"])
        vocabulary = np.concatenate([_unpack_keys(r["e"]) for r in answers])
        stream = _by_frequency(_unpack(body["f"], np.uint32))[_unpack(body["b"], np.uint32)]
        sizes, folds = _unpack(body["c"], np.uint32).astype(np.int64), _unpack(body["d"], np.uint8)
        ids = pa.ipc.open_stream(body["e"]).read_all().column(0).combine_chunks()
        uni, uni_own, big, big_own = (np.concatenate([_unpack(r[c], np.uint64) for r in answers]) for c in "abcd")
        _, index = np.unique(_bigrams(vocabulary[stream], sizes), return_inverse=True)
        cut = np.concatenate(([0], np.cumsum(sizes)))
        step = 1 << 19
        lo = 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + step, "right")) - 1)
            s, some = slice(cut[lo], cut[hi]), sizes[lo:hi]
            none = np.where(folds[lo:hi] == FOLD, some, 0)
            own = np.repeat(folds[lo:hi] == FOLD, some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(hi - lo, BODY, np.int32)), ids.slice(lo, hi - lo), pa.array(folds[lo:hi].astype(np.int32)), pa.array(some), _planes(big[index[s]], some), _planes(uni[stream[s]], some), _planes(big_own[index[s]][own], none), _planes(uni_own[stream[s]][own], none)],
                names=COUNTED.names,
            )
            lo = hi

    body, answers = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == TOTAL:
                yield pa.RecordBatch.from_arrays([pa.array([TOTAL], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([int.from_bytes(r["a"], "little")], pa.int64()), *[pa.array([b""])] * 4], names=COUNTED.names)
            elif r["kind"] == BODY:
                if body is not None:
                    yield from close(body, answers)
                body, answers = r, []
            else:
                answers.append(r)
    if body is not None:
        yield from close(body, answers)


def count(df: DataFrame, doc_id: str, text: str, fold: str) -> DataFrame:
    """One row a text with the counts of its events in the training texts, and
    for texts of the fold in the fold alone; rows of kind TOTAL add up to V."""
    n = parts(df.sparkSession, df, 24 << 20)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(fold).cast("int").alias("fold"))
    sent = docs.mapInArrow(_blocks(n), SENT)
    answered = sent.repartition(n, "dest").mapInArrow(_answers, SENT)
    # a body (kind 0) comes before its block's answers
    return answered.repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(_counted, COUNTED)


@dataclass(frozen=True)
class Model:
    """Mixture weights (bigram, unigram, uniform) of each bucket, and totals."""

    weights: np.ndarray
    n: int
    v: int
    n_fold: int
    texts: int
    fold_texts: int


def _estimates(big: np.ndarray, uni: np.ndarray, sizes: np.ndarray, texts: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, c(h, w) / c(h), c(w) / N) of events; the first context of a text was seen ``texts`` times."""
    context = np.empty(len(uni), np.float64)
    context[1:] = uni[:-1]
    context[np.cumsum(sizes) - sizes] = texts
    bucket = np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)
    return bucket, np.divide(big, context, out=np.zeros(len(uni)), where=context > 0), uni / max(n, 1)


def _unplanes(column, sizes: np.ndarray) -> np.ndarray:
    """The inverse of ``_planes``, of all texts end to end; a text has its size
    of counts or none."""
    data, offsets = K.buffers(column)
    lengths = np.diff(offsets)
    own = np.where(lengths > 0, sizes, 0)
    width = lengths // np.maximum(own, 1)
    begin = np.cumsum(own) - own
    out = np.zeros(int(own.sum()))
    for k in range(int(width.max(initial=0))):
        some = np.flatnonzero(width > k)
        out[K.ranges(begin[some], own[some])] += data[K.ranges(offsets[some] + k * own[some], own[some])] * float(1 << (8 * k))
    return out


def _slices(batch: pa.RecordBatch, size: int = 1 << 19):
    """The batch in runs of rows with about ``size`` events, one row at least."""
    cut = np.concatenate(([0], np.cumsum(batch.column(3).to_numpy(zero_copy_only=False))))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def fit(counted: DataFrame, rounds: int = 60) -> Model:
    """Learns the weights by EM on the fold's events under the deleted counts.

    Events are gathered in a grid of bounded size (bucket and the logarithms of
    both estimates) with exact sums; only its cells reach the driver.
    """
    totals = counted.agg(
        F.sum(F.when(F.col("kind") == TOTAL, F.col("n"))).alias("v"),
        F.sum(F.when((F.col("kind") == BODY) & (F.col("fold") != HELD), F.col("n"))).alias("n"),
        F.sum(F.when((F.col("kind") == BODY) & (F.col("fold") == FOLD), F.col("n"))).alias("n_fold"),
        F.count(F.when((F.col("kind") == BODY) & (F.col("fold") != HELD), F.lit(1))).alias("texts"),
        F.count(F.when((F.col("kind") == BODY) & (F.col("fold") == FOLD), F.lit(1))).alias("fold_texts"),
    ).first()
    n, n_fold, v = totals.n or 0, totals.n_fold or 0, totals.v or 0
    main_texts = totals.texts - totals.fold_texts

    def cells(batches):
        for batch in (part for whole in batches for part in _slices(whole)):
            sizes = batch.column(3).to_numpy(zero_copy_only=False)
            big, uni, big_own, uni_own = (_unplanes(batch.column(k), sizes) for k in range(4, 8))
            b, two, one = _estimates(big - big_own, uni - uni_own, sizes, main_texts, n - n_fold)
            q = [np.where(p > 0, np.round(-GRID * np.log2(np.where(p > 0, p, 1))) + 1, 0).astype(np.int64) for p in (two, one)]
            key, index = np.unique((b << 40) | (q[0] << 20) | q[1], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(index).astype(np.int64)), pa.array(np.bincount(index, two)), pa.array(np.bincount(index, one))], names=["cell", "n", "two", "one"])

    events = counted.where((F.col("kind") == BODY) & (F.col("fold") == FOLD)).mapInArrow(cells, "cell long, n long, two double, one double")
    grid = events.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("two").alias("two"), F.sum("one").alias("one")).toPandas().sort_values("cell")
    amount = grid.n.to_numpy(np.float64)
    bucket = (grid.cell.to_numpy(np.int64) >> 40) if len(grid) else np.zeros(0, np.int64)
    p = np.stack([grid.two.to_numpy(np.float64) / amount, grid.one.to_numpy(np.float64) / amount, np.full(len(grid), 1 / (v + 1))]) if len(grid) else np.zeros((3, 0))
    weights = np.full((3, BUCKETS), 1 / 3)
    weights[:, 0] = (0, 0.5, 0.5)  # an unseen context has no bigram estimate
    for _ in range(rounds):
        share = weights[:, bucket] * p
        share /= share.sum(axis=0)
        # one event more for each component, so that no weight becomes zero
        mass = np.stack([np.bincount(bucket, s * amount, BUCKETS) for s in share]) + 1.0
        mass[0, 0] = 0
        weights = mass / mass.sum(axis=0)
    if not n:
        weights[:] = np.array([0, 0, 1])[:, None]
    return Model(weights, n, v, n_fold, totals.texts, totals.fold_texts)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(counted: DataFrame, model: Model) -> DataFrame:
    """Scores each counted text under the model and under the smoothed unigrams."""

    def run(batches):
        for batch in (part for whole in batches for part in _slices(whole)):
            sizes = batch.column(3).to_numpy(zero_copy_only=False)
            big, uni = _unplanes(batch.column(4), sizes), _unplanes(batch.column(5), sizes)
            first = np.cumsum(sizes) - sizes
            b, two, one = _estimates(big, uni, sizes, model.texts, model.n)
            w = model.weights[:, b]
            p = np.log10(w[0] * two + w[1] * one + w[2] / (model.v + 1))
            base = np.log10((uni + 1) / (model.n + model.v + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(batch.column(2).to_numpy(zero_copy_only=False) == HELD), pa.array(sizes), pa.array(np.add.reduceat((uni > 0).astype(np.int64), first)), pa.array(np.full(len(sizes), model.n)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(p, first))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return counted.where(F.col("kind") == BODY).select("kind", "doc_id", "fold", "n", "big", "uni").mapInArrow(run, SCORED)


def folds(doc_id: str, modulus: int = 7, held: int = 2, fold: int = 3):
    """The fold of a row by the checksum of its id: HELD, FOLD or TRAIN; null: TRAIN."""
    k = F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))
    return F.when(k == held, F.lit(HELD)).when(k == fold, F.lit(FOLD)).otherwise(F.lit(TRAIN))


def learn_and_score(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from all texts but the held-out ones and scores every text."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("fold", folds("doc_id"))
    counted = written(count(docs, "doc_id", "text", "fold"), "interpolation-counts")
    return score(counted, fit(counted))
