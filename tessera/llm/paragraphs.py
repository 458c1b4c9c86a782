"""Substring deduplication by paragraph MinHash banding.

A paragraph is what stands between blank lines, so hard-wrapped lines are one;
in a text without a blank line each line is a paragraph.  Paragraphs of
``SHINGLE`` words or more are compared: MinHash signatures of five-word shingles
are cut into bands tuned for recall at the threshold, paragraphs that collide in
a band are joined, exact Jaccard similarity of their shingle sets decides, and
links make components.  A passage that was put into other text stands in no
paragraph of its own, so runs of ``RUN`` words are compared as well.  A run's
anchor is the least hash of its ``STEP`` windows of ``WINDOW`` words, so equal
runs have equal anchors wherever they stand; neighbouring runs of one anchor make
a unit.  Where an anchor is repeated, equal units are compared as wholes, and the
runs of one of each by their own hashes.  Overlapping repeated runs are joined,
so that a passage is found from its first word to its last.

Paragraphs and runs that occur in two or more documents are repeated.  The
document of the smallest id keeps its occurrences; in the others the spans of
runs, and of paragraphs of ``MIN_WORDS`` words or more, are removed.  Shorter
paragraphs are linked and counted (``n_similar``), and removed if ``min_words``
says so.

Scale: equal paragraphs collapse to one first.  A bucket's shingle sets meet in
one task if they are small together (``GROUP`` shingles); there all pairs that
are not yet connected are compared, by an index of their rarest shingles.  Larger
buckets are dealt over blocks which all hold one centre; what is then not
connected to the bucket's main component is compared with every block.  So no
pair of a bucket is passed over, and no task holds more than a few blocks.
Buckets with the same members count once.  Other grouping is by aggregates
combined before the shuffle (smallest and largest document of a key), joined
back, so a passage in a third of all documents is a skewed join key.

Defined results: null and empty texts have no paragraph; rows with a null
``doc_id`` take no part and stay unchanged; rows that share a ``doc_id`` are
one document, whose own repeats stay; other columns stay as they are, whatever
their names.  Ids must be integers or cast to them.  A very long text is held
whole by one task, with about a hundred bytes a word; its rows are not.  An
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.skew import dealt_join

from . import kernels as K
from .components import connected_components
from .interpolation import _pack, _unpack
from .shared import drop, fresh, written

SHINGLE = 5
THRESHOLD = 0.8
#: Share of pairs at the threshold that some band must bring together.
RECALL = 0.995
ROWS = 3
#: Shorter paragraphs are linked and counted, but not removed.
MIN_WORDS = 36
WINDOW, STEP = 26, 25
#: Words of the shortest run that is repeated.
RUN = WINDOW + STEP - 1
#: Shingles of the paragraphs that are compared in one group.
GROUP = 1 << 18
PARAGRAPH, ANCHOR, TEXT, RUNS = range(4)
_MUL = K.mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_ADD = K.mix(np.arange(257, 513, dtype=np.uint64))
_R = np.uint64(0x9FB21C651E98DF25)


def bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The number of bands of ``rows`` that finds pairs at the threshold with the given probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _sliding(a: np.ndarray, width: int, f, pad) -> np.ndarray:
    """f over a[i : i + width], by doubling."""
    out, have = a.copy(), 1
    while have < width:
        step = min(have, width - have)
        moved = np.full_like(out, pad)
        moved[: len(out) - step] = out[step:]
        out = f(out, moved)
        have += step
    return out


def _prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums over word hashes, and inverse powers, for window hashes."""
    power = np.full(len(h) + 1, _R, np.uint64)
    power[0] = 1
    inverse = np.full(len(h) + 1, pow(int(_R), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    power, inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64))), inverse


def _of_words(prefix: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sums, inverse = prefix
    return K.mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))


def anchors(prefix, word_ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first run, end of the last run, anchor) of each unit, in words; a run lies
    in one text, and ``word_ends`` is, for each word, its text's end."""
    most = np.iinfo(np.uint64).max
    h = np.full(n, most, np.uint64)
    at = np.flatnonzero(np.arange(n) + WINDOW <= word_ends)
    h[at] = _of_words(prefix, at, at + WINDOW)
    runs = np.flatnonzero(np.arange(n) + RUN <= word_ends)
    least = _sliding(h, STEP, np.minimum, most)[runs]
    if not len(runs):
        return runs, runs, least
    first = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (runs[1:] != runs[:-1] + 1))))
    return runs[first], runs[np.append(first[1:], len(runs)) - 1] + RUN, least[first]


def blocks(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The paragraphs of all texts, as ranges of their words."""
    a, b = K.spans(data != 0x0A, offsets)
    a, b = np.searchsorted(starts, a), np.searchsorted(starts, b)
    a, b = a[b > a], b[b > a]
    if not len(a):
        return a, b
    owner = np.searchsorted(offsets, starts[a], "right") - 1
    breaks = np.flatnonzero(data == 0x0A)
    between = np.searchsorted(breaks, starts[a[1:]]) - np.searchsorted(breaks, ends[b[:-1] - 1])
    same = owner[1:] == owner[:-1]
    wrapped = np.zeros(len(offsets), bool)
    wrapped[owner[1:][same & (between > 1)]] = True
    first = np.concatenate(([True], ~same | ~wrapped[owner[1:]] | (between > 1)))
    return a[first], b[np.append(first[1:], True)]


def line_signatures(words: np.ndarray, a: np.ndarray, b: np.ndarray, n_bands: int, rows: int = ROWS) -> np.ndarray:
    """Band hashes (lines x bands) of lines of words [a, b), of SHINGLE words at least."""
    grams = K.ngram_hashes(words, SHINGLE)
    sizes = b - a - SHINGLE + 1
    some = grams[K.ranges(a, sizes)]
    first = np.cumsum(sizes) - sizes
    out = np.zeros((len(a), n_bands), np.uint64)
    for k in range(n_bands):
        band = np.full(len(a), np.uint64(k + 1))
        for r in range(rows):
            v = some * _MUL[k * rows + r]
            v ^= _ADD[k * rows + r]
            v ^= v >> np.uint64(32)
            v *= np.uint64(0xBF58476D1CE4E5B9)
            band = K.pair(band, np.minimum.reduceat(v, first))
        out[:, k] = band
    return out


UNITS = "kind int, key long, whole long, doc_id long, text_key long, first_word int, end_word int, bands array<long>"


def _read(data: np.ndarray, offsets: np.ndarray):
    """(word starts, word ends, word hashes, bounds of the texts' words, the end of each word's text)."""
    lower = K.LOWER[data]
    starts, ends = K.spans(K.GRAPHIC[lower], offsets)
    bounds = np.searchsorted(starts, offsets)
    return starts, ends, K.span_hashes(lower, starts, ends), bounds, np.repeat(bounds[1:], np.diff(bounds))


def units(df: DataFrame, n_bands: int) -> DataFrame:
    """All paragraphs and units (kind ANCHOR; ``key`` is the anchor's hash, ``whole``
    the unit's) of (doc_id, text_key, text), and a row of kind TEXT for each row
    with its words and paragraphs (``end_word``, ``first_word``)."""

    def run(batches):
        names = [f.split()[0] for f in UNITS.split(", ")]
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(2), 1 << 20):
                starts, ends, words, bounds, word_ends = _read(data, offsets)
                owner = np.repeat(np.arange(hi - lo), np.diff(bounds))
                prefix = _prefix(words)
                la, lb = blocks(data, offsets, starts, ends)
                many = np.bincount(owner[la], minlength=hi - lo) if len(la) else np.zeros(hi - lo)
                la, lb = la[lb - la >= SHINGLE], lb[lb - la >= SHINGLE]
                ja, jb, jh = anchors(prefix, word_ends, len(words))
                n_line, n_pass, n_text = len(la), len(ja), hi - lo
                row = np.concatenate((owner[la], owner[ja], np.arange(n_text)))
                signature = line_signatures(words, la, lb, n_bands) if n_line else np.zeros((0, n_bands), np.uint64)
                offs = np.concatenate((np.arange(n_line + 1) * n_bands, np.full(n_pass + n_text, n_line * n_bands))).astype(np.int32)
                ints = lambda *x: pa.array(np.concatenate(x).astype(np.int32))
                own, none = bounds[:-1], np.zeros(n_pass)
                keys = lambda *x: pa.array(np.concatenate(x).view(np.int64))
                zeros = np.zeros(n_text, np.uint64)
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array([PARAGRAPH, ANCHOR, TEXT], np.int32), [n_line, n_pass, n_text])),
                        keys(_of_words(prefix, la, lb), jh, zeros), keys(np.zeros(n_line, np.uint64), _of_words(prefix, ja, jb), zeros),
                        rows.column(0).take(pa.array(row)), rows.column(1).take(pa.array(row)),
                        ints(la - own[owner[la]], none, many), ints(lb - own[owner[la]], none, np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(offs), pa.array(signature.ravel().view(np.int64))),
                    ],
                    names=names,
                )

    return df.mapInArrow(K.task(run), UNITS)


MARKS = "kind int, key long, doc_id long, text_key long, first_word int, end_word int, keeper long, high long, shingles array<long>"


def _marks(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The shingle sets of wanted paragraphs, the places of repeated units, and
    each run of those units that their document keeps.

    ``places`` has (doc_id, kind, key, text_key, first_word, end_word, keeper,
    high): the words of a PARAGRAPH in one text of the document, or a unit's hash
    (ANCHOR) with the first and last document of all that are equal to it.
    """
    by_doc = places.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "key", "text_key", "first_word", "end_word", "keeper", "high")).alias("places"))
    joined = docs.join(by_doc, "doc_id").select("doc_id", "text_key", "places", "text")

    def run(batches):
        names = [f.split()[0] for f in MARKS.split(", ")]
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(3), 1 << 20):
                starts, _, words, bounds, word_ends = _read(data, offsets)
                prefix = _prefix(words)
                rows = batch.slice(lo, hi - lo)
                nested = rows.column(2)
                kind, key, of_text, first, end, keeper, high = (c.to_numpy(zero_copy_only=False) for c in nested.flatten().flatten())
                row = np.repeat(np.arange(hi - lo), nested.value_lengths().to_numpy(zero_copy_only=False))
                line = np.flatnonzero((kind == PARAGRAPH) & (of_text == rows.column(1).to_numpy(zero_copy_only=False)[row]))
                a, b = bounds[row[line]] + first[line], bounds[row[line]] + end[line]
                sizes = b - a - SHINGLE + 1
                grams, of = K.ngram_hashes(words, SHINGLE)[K.ranges(a, sizes)], np.repeat(np.arange(len(a)), sizes)
                order = np.lexsort((grams, of))
                grams, of = grams[order], of[order]
                new = np.ones(len(of), bool)
                new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
                grams, of = grams[new], of[new]
                # the texts' own units, by the hash of text and unit
                ja, jb, _ = anchors(prefix, word_ends, len(words))
                text = np.searchsorted(bounds, ja, "right") - 1
                asked = np.flatnonzero(kind == ANCHOR)
                names_of = K.pair(row[asked].astype(np.uint64), key[asked].view(np.uint64))
                asked = asked[np.argsort(names_of, kind="stable")]
                names_of = np.sort(names_of)
                mine = K.pair(text.astype(np.uint64), _of_words(prefix, ja, jb))
                at = np.minimum(np.searchsorted(names_of, mine), max(len(names_of) - 1, 0))
                some = np.flatnonzero(names_of[at] == mine) if len(asked) else np.zeros(0, np.int64)
                ja, jb, text, asked = ja[some], jb[some], text[some], asked[at[some]] if len(asked) else asked
                kept = keeper[asked] == rows.column(0).to_numpy(zero_copy_only=False)[text]
                many = np.where(kept, jb - RUN + 1 - ja, 0)
                unit, begin = np.repeat(np.arange(len(ja)), many), K.ranges(ja, many)
                copy = np.flatnonzero(~kept)
                # one row a paragraph, a copy and a run
                x, y = np.concatenate((a, ja[copy], begin)), np.concatenate((b, jb[copy], begin + RUN))
                owner = np.concatenate((row[line], text[copy], text[unit]))
                place = np.concatenate((line, asked[copy], asked[unit]))
                hashes = np.concatenate((key[line], key[asked[copy]], _of_words(prefix, begin, begin + RUN).view(np.int64)))
                offs = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(a))), np.full(len(place) - len(a), len(grams)))).astype(np.int32)
                ids = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array([PARAGRAPH, ANCHOR, RUNS], np.int32), [len(a), len(copy), len(begin)])), pa.array(hashes),
                        rows.column(0).take(ids), rows.column(1).take(ids),
                        *(pa.array((v - bounds[owner]).astype(np.int32)) for v in (x, y)),
                        pa.array(keeper[place]), pa.array(high[place]),
                        pa.ListArray.from_arrays(pa.array(offs), pa.array(grams.view(np.int64))),
                    ],
                    names=names,
                )

    return joined.mapInArrow(K.task(run), MARKS)


def link_group(values: np.ndarray, offsets: np.ndarray, label: np.ndarray, centre: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links that connect what all links of Jaccard >= threshold between the sets
    ``values[offsets[i] : offsets[i + 1]]`` connect, given that equal labels are
    connected.  Only pairs with a member of ``centre`` are looked at."""
    n = len(label)
    sizes = np.diff(offsets)
    _, ids, often = np.unique(values, return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(n), sizes)
    order = np.lexsort((ids, often[ids], member))
    ids = ids[order]  # of each set, the rarest first
    by_token = np.argsort(ids, kind="stable")
    holders, first = member[by_token], np.concatenate(([0], np.cumsum(often)))
    _, comp = np.unique(label, return_inverse=True)
    todo, every, found = centre.copy(), bool(centre.all()), []
    mask = np.zeros(len(often), bool)
    while True:
        rest = todo
        if every:  # the main component's members are compared from the other side
            rest = todo & (comp != np.bincount(comp).argmax())
        left = np.flatnonzero(rest)
        if not len(left):
            return found
        c = int(left[0])
        todo[c] = False
        own = ids[offsets[c] : offsets[c + 1]]
        head = own[: len(own) - math.ceil(threshold * len(own) - 1e-9) + 1]
        near = np.unique(holders[K.ranges(first[head], often[head])])
        near = near[(comp[near] != comp[c]) & (np.minimum(sizes[near], sizes[c]) >= threshold * np.maximum(sizes[near], sizes[c]) - 1e-9)]
        if not len(near):
            continue
        mask[own] = True
        common = np.add.reduceat(mask[ids[K.ranges(offsets[near], sizes[near])]].astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
        mask[own] = False
        for x in near[common >= threshold * (sizes[near] + sizes[c] - common) - 1e-9].tolist():
            if comp[x] != comp[c]:
                found.append((c, x))
                comp[comp == comp[x]] = comp[c]


def _link_pairs(values: np.ndarray, offsets: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets 2 k and 2 k + 1 are linked, for every k."""
    sizes = np.diff(offsets)
    pair = np.repeat(np.arange(len(sizes)) // 2, sizes)
    order = np.lexsort((values, pair))
    twice = (values[order][1:] == values[order][:-1]) & (pair[order][1:] == pair[order][:-1])
    common = np.bincount(pair[order][1:][twice], minlength=len(sizes) // 2)
    return common >= threshold * (sizes[::2] + sizes[1::2] - common) - 1e-9


GROUPS = ["bucket", "block", "key", "label", "centre", "shingles"]


def _verify(groups: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of links in groups (bucket, block) of (key, label, centre, shingles)."""
    dealt = groups.select(*GROUPS).withColumn("part", F.xxhash64("bucket", "block")).repartition("part").sortWithinPartitions("bucket", "block").drop("part")

    def close(parts):
        keys, labels, centres, values = (np.concatenate([p[k] for p in parts]) for k in range(4))
        offsets = np.concatenate(([0], np.cumsum(np.concatenate([p[4] for p in parts]))))
        return [(keys[a], keys[b]) for a, b in link_group(values, offsets, labels, centres, threshold)]

    def run(batches):
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, block, keys, labels, centres = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            sets = batch.column(5)
            values = sets.flatten().to_numpy(zero_copy_only=False)
            sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            cut = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1]), [True])))
            found, pairs = [], []
            for k, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                name = (bucket[lo], block[lo])
                if held and name != now:
                    found += close(held)
                    held = []
                now = name
                if hi == cut[-1] or held:
                    held.append((keys[lo:hi], labels[lo:hi], centres[lo:hi], values[offsets[lo] : offsets[hi]], sizes[lo:hi]))
                elif hi - lo == 2:
                    pairs.append(lo)
                else:
                    found += close([(keys[lo:hi], labels[lo:hi], centres[lo:hi], values[offsets[lo] : offsets[hi]], sizes[lo:hi])])
            if pairs:
                both = np.stack((pairs, np.array(pairs) + 1), 1).ravel()
                near = _link_pairs(values[K.ranges(offsets[both], sizes[both])], np.concatenate(([0], np.cumsum(sizes[both]))), threshold)
                near &= (labels[both[::2]] != labels[both[1::2]]) & (centres[both[::2]] | centres[both[1::2]])
                found += zip(keys[both[::2]][near], keys[both[1::2]][near], strict=True)
            if found:
                yield _links(found)
        if held:
            found = close(held)
            if found:
                yield _links(found)

    return dealt.mapInArrow(K.task(run), "u long, v long")


def _links(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(u) for u, _ in found], pa.int64()), pa.array([int(v) for _, v in found], pa.int64())], names=["u", "v"])


def candidates(paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct paragraphs with the place of one occurrence, members of buckets
    with two or more of them); buckets of the same members count once."""
    at = F.min(F.struct("doc_id", "text_key", "first_word", "end_word")).alias("at")
    reps = written(paragraphs.groupBy("key").agg(at, F.first("bands").alias("bands")), "paragraph-distinct")
    banded = reps.select("key", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sizes = reps.select("key", (F.col("at.end_word") - F.col("at.first_word")).cast("long").alias("size"))
    full = written(dealt_join(banded, shared.select("bucket"), "bucket").join(sizes, "key"), "paragraph-buckets")
    same = full.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum("size").alias("weight"))
    once = same.groupBy("n", "low", "high", "x").agg(F.min("bucket").alias("bucket"), F.first("weight").alias("weight"))
    return reps, full.drop("size").join(once.select("bucket", "weight"), "bucket")


def _wanted(reps: DataFrame, members: DataFrame) -> DataFrame:
    """One place of every paragraph that stands in a bucket with others."""
    none = F.lit(0).cast("long")
    return reps.join(members.select("key").distinct(), "key").select(F.lit(PARAGRAPH).alias("kind"), "key", "at.*", none.alias("keeper"), none.alias("high"))


def paragraph_components(members: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """(key, component) of the distinct paragraphs that are linked to another one."""
    n = F.ceil(F.col("weight") / group)
    block = F.pmod(F.xxhash64("key"), n)
    heavy = members.where(F.col("weight") > group)
    plain = members.select("bucket", block.alias("block"), "key", F.col("key").alias("label"), F.lit(True).alias("centre"))
    # one centre stands in every block of its bucket
    centres = heavy.groupBy("bucket").agg(F.min_by("key", F.xxhash64("key", F.lit(1))).alias("key"), F.first("weight").alias("weight"))
    spread = centres.select("bucket", "key", block.alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block")).where("block <> home")
    groups = plain.unionByName(spread.select("bucket", "block", "key", F.col("key").alias("label"), F.lit(True).alias("centre")))
    links = written(_verify(groups.join(sets, "key"), threshold), "paragraph-links")
    components = connected_components(links, "u", "v", "paragraph-components")
    if heavy.first() is not None:
        # what is outside a bucket's main component meets every block of the bucket
        labelled = heavy.join(components.select(F.col("id").alias("key"), "component"), "key", "left").withColumn("label", F.coalesce("component", "key"))
        counted = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.first("weight").alias("weight"))
        main = counted.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"), F.sum("n").alias("all"), F.first("weight").alias("whole")).where("outside > 0")
        far = dealt_join(labelled, main, "bucket")
        m = F.ceil(F.col("whole") / group)
        s = F.ceil(F.col("whole") * F.col("outside") / F.col("all") / group)
        upto = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), x - 1))
        own_m, own_s = F.pmod(F.xxhash64("key"), m), F.pmod(F.xxhash64("key", F.lit(2)), s)
        one = far.where("label <> main").select("bucket", "key", "label", F.lit(True).alias("centre"), own_s.alias("i"), m.alias("m"), upto(m).alias("j"))
        two = far.select("bucket", "key", "label", F.lit(False).alias("centre"), own_m.alias("j"), m.alias("m"), upto(s).alias("i"))
        pairs = one.unionByName(two).withColumn("block", F.col("i") * F.col("m") + F.col("j"))
        more = written(_verify(pairs.join(sets, "key"), threshold), "paragraph-links")
        if more.first() is not None:
            components = connected_components(links.unionByName(more), "u", "v", "paragraph-components")
        drop(more)
    drop(links)
    return components.select(F.col("id").alias("key"), "component")


def paragraph_links(paragraphs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """(key, component) of paragraphs (rows of ``units``) of ``docs`` that are linked to another one."""
    reps, members = candidates(paragraphs)
    sets = written(_marks(docs, _wanted(reps, members)).dropDuplicates(["key"]).select("key", "shingles"), "paragraph-sets")
    return paragraph_components(members, sets, threshold, group)


_SPANS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("first_word", "end_word")])
#: Spans as they are returned: bytes are positions in the text's UTF-8.
PLACED = T.StructType([*_SPANS.fields, T.StructField("start_byte", T.IntegerType()), T.StructField("end_byte", T.IntegerType())])


def _union_spans(df: DataFrame) -> DataFrame:
    """Replaces ``spans`` (each with ``cut`` and ``run``) by the union of those to
    cut, in order; counts its words, and the passages that all runs make."""
    extra = [T.StructField("removed_words", T.LongType()), T.StructField("n_runs", T.LongType())]
    at = df.columns.index("spans")
    schema = T.StructType([*(T.StructField("spans", T.ArrayType(_SPANS)) if f.name == "spans" else f for f in df.schema.fields), *extra])
    kind = pa.list_(pa.struct([pa.field(f.name, pa.int32()) for f in _SPANS.fields]))

    def union(s):
        s = s[:, np.lexsort((s[1], s[0]))]
        reach = np.maximum.accumulate(s[1])
        cut = np.concatenate(([True], s[0][1:] > reach[:-1]))[: len(reach)]
        last = np.append(np.flatnonzero(cut)[1:] - 1, len(reach) - 1)[: cut.sum()]
        return np.stack([s[0][cut], reach[last]], axis=1)

    def run(batches):
        for batch in batches:
            spans, words, runs = [], [], []
            for row in batch.column(at):
                *s, cut, of_run = (f.to_numpy(zero_copy_only=False) for f in row.values.flatten())
                s = np.stack(s)
                rows = union(s[:, cut.astype(bool)])
                spans.append([dict(zip(_SPANS.names, r, strict=True)) for r in rows.tolist()])
                words.append(int((rows[:, 1] - rows[:, 0]).sum()))
                runs.append(len(union(s[:, of_run.astype(bool)])))
            columns = list(batch.columns)
            columns[at] = pa.array(spans, kind)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), pa.array(runs, pa.int64())], names=schema.names)

    return df.mapInArrow(run, schema)


def _word_gaps(batches):
    """Task body: for each text the bytes before its words and of its words, packed."""
    for batch in batches:
        for lo, hi, data, offsets in K.chunks(batch.column(2)):
            starts, ends = K.spans(K.GRAPHIC[data], offsets)
            cut, edges, packed = K.bounds(starts, offsets), np.stack([starts, ends], axis=1).ravel(), []
            for a, b, base in zip(cut[:-1].tolist(), cut[1:].tolist(), offsets[:-1].tolist(), strict=True):
                steps = np.diff(edges[2 * a : 2 * b], prepend=base).astype(np.uint32)
                packed.append(_pack(np.concatenate([steps[::2], steps[1::2]])))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["doc_id", "text_key", "words"])


def _placed(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``found`` with the bytes of its spans.  No text is shuffled for them, but
    the packed lengths of its words and gaps, once for equal texts of a document."""
    some = F.size("spans") > 0
    by = ["doc_id", "text_key"]
    gaps = docs.mapInArrow(K.task(_word_gaps), "doc_id long, text_key long, words binary")
    words = gaps.groupBy(*by).agg(F.first("words").alias("words"))
    joined = found.where(some).join(words, by).select(*found.columns, "words")
    at = found.columns.index("spans")
    schema = T.StructType([T.StructField("spans", T.ArrayType(PLACED)) if f.name == "spans" else f for f in found.schema.fields])

    def run(batches):
        for batch in batches:
            spans, words = batch.column(at), batch.column(batch.num_columns - 1)
            first, end = (c.to_numpy(zero_copy_only=False) for c in spans.flatten().flatten())
            cut = np.concatenate(([0], np.cumsum(spans.value_lengths().to_numpy(zero_copy_only=False))))
            start_byte, end_byte = np.empty(len(first), np.int32), np.empty(len(first), np.int32)
            for i, packed in enumerate(words):
                gaps, sizes = _unpack(packed.as_py(), np.uint32).astype(np.int64).reshape(2, -1)
                ends, own = np.cumsum(gaps + sizes), slice(cut[i], cut[i + 1])
                start_byte[own], end_byte[own] = (ends - sizes)[first[own]], ends[end[own] - 1]
            values = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in (first, end, start_byte, end_byte)], names=PLACED.names)
            columns = list(batch.columns)[:-1]
            columns[at] = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    none = F.array().cast(T.ArrayType(PLACED))
    return joined.mapInArrow(K.task(run), schema).unionByName(found.where(~some).withColumn("spans", none))


def _repeated(rows: DataFrame, key: str = "key") -> DataFrame:
    """(key, keeper): the keys of two or more documents and the smallest of these."""
    return rows.groupBy(key).agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("high")).where("keeper < high").drop("high")


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_key, text) of the rows that have an id."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(text).alias("text")).where("doc_id is not null")


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each distinct (doc_id, text): its words and paragraphs, how
    many repeated passages it has (runs, and paragraphs of ``min_words``), how
    many paragraphs of any length have a like in other documents, its class (the
    smallest document reachable by repeated passages), and the spans to remove,
    in words and in bytes."""
    docs = _keyed(df, doc_id, text)
    return _placed(written(_in_words(docs, threshold, recall, min_words), "paragraph-found"), docs)


def _in_words(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, min_words: int = MIN_WORDS) -> DataFrame:
    """What ``find`` returns, its spans in words only."""
    every = written(units(docs, bands(threshold, recall)), "paragraph-units")
    paragraphs, by = every.where(F.col("kind") == PARAGRAPH), ["doc_id", "text_key"]
    reps, members = candidates(paragraphs)
    units_of = every.where(F.col("kind") == ANCHOR).select("key", "whole", "doc_id")
    # units of repeated anchors, and the first and last document of all that are equal
    anchored = written(dealt_join(units_of, _repeated(units_of).select("key"), "key").drop("key"), "paragraph-units-repeated")
    ends = anchored.groupBy("whole").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("high"))
    zero = F.lit(0)
    places = dealt_join(anchored, ends, "whole").select("doc_id", F.lit(ANCHOR).alias("kind"), F.col("whole").alias("key"), zero.cast("long").alias("text_key"), zero.alias("first_word"), zero.alias("end_word"), "keeper", "high")
    marks = written(_marks(docs, places.unionByName(_wanted(reps, members))), "paragraph-marks")
    drop(anchored)
    drop(reps)
    sets = marks.where(F.col("kind") == PARAGRAPH).select("key", "shingles").dropDuplicates(["key"])
    linked = paragraph_components(members, sets, threshold)

    place = ["first_word", "end_word"]
    slim = paragraphs.select("key", *by, *place)
    classed = slim.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).join(linked, "key", "left").withColumn("class", F.coalesce("component", "key"))
    keepers = classed.groupBy("class").agg(F.min("low").alias("keeper"), F.max("high").alias("high")).where("keeper < high")
    alike = dealt_join(slim, dealt_join(classed.select("key", "class"), keepers, "class").select("key", "keeper"), "key").drop("key").withColumn("run", F.lit(False))

    runs = marks.where(F.col("kind") == RUNS).drop("kind", "keeper", "shingles", "end_word")
    first = runs.groupBy("key").agg(F.min("doc_id").alias("keeper"), F.max("high").alias("high")).where("keeper < high").drop("high")
    again = dealt_join(runs.drop("high"), first, "key").drop("key")
    # overlapping runs are one passage: their first words follow each other
    order = Window.partitionBy(*by, "keeper").orderBy("first_word")
    islands = again.withColumn("island", F.col("first_word") - F.dense_rank().over(order)).groupBy(*by, "keeper", "island")
    passages = islands.agg(F.min("first_word").alias("first_word"), (F.max("first_word") + RUN).alias("end_word")).drop("island")
    copies = marks.where(F.col("kind") == ANCHOR).select(*by, *place, "keeper")
    found = written(alike.unionByName(passages.unionByName(copies).withColumn("run", F.lit(True))), "paragraph-repeats")
    drop(marks)

    whole = F.col("run") | (F.col("end_word") - F.col("first_word") >= min_words)
    cut = F.col("doc_id") != F.col("keeper")
    links = found.where(whole & cut).select("doc_id", "keeper").distinct()
    classes = connected_components(links, "doc_id", "keeper", "paragraph-classes").select(F.col("id").alias("doc_id"), F.col("component").alias("class_id"))
    counted = every.where(F.col("kind") == TEXT).groupBy(*by).agg(F.max("end_word").cast("long").alias("n_words"), F.max("first_word").cast("long").alias("n_paragraphs"))
    gathered = found.groupBy(*by).agg(
        F.count(F.when(whole & ~F.col("run"), F.lit(1))).alias("n_long"),
        F.count(F.when(~F.col("run"), F.lit(1))).alias("n_similar"),
        F.collect_set(F.when(whole & (cut | F.col("run")), F.struct(*place, cut.alias("cut"), "run"))).alias("spans"),
    )
    out = counted.join(_union_spans(gathered), by, "left").join(classes, "doc_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", "text_key", F.coalesce("class_id", "doc_id").alias("class_id"), "n_words", "n_paragraphs",
        (none("n_long") + none("n_runs")).alias("n_repeated"), none("n_similar").alias("n_similar"), none("removed_words").alias("removed_words"),
        F.coalesce("spans", F.array().cast(T.ArrayType(_SPANS))).alias("spans"),
    )


def remove(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` without the repeated passages of its texts.  A row whose text has
    words but none left is dropped; all others keep their columns."""
    found = _in_words(_keyed(df, doc_id, text), **options).where("removed_words > 0")
    own, key, cut, words, left = (fresh(df, n) for n in ("_doc", "_key", "_cut", "_words", "_left"))
    spans = found.select(F.col("doc_id").alias(own), F.col("text_key").alias(key), F.col("spans").alias(cut), (F.col("n_words") - F.col("removed_words")).alias(words))
    joined = df.join(spans, (F.col(doc_id).cast("long") == F.col(own)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(key)), "left").where(F.coalesce(F.col(words), F.lit(1)) > 0).drop(own, key, words)
    at, place = joined.columns.index(text), joined.columns.index(cut)
    schema = T.StructType([f for f in joined.schema.fields if f.name != cut])
    names = schema.names

    def run(batches):
        for batch in batches:
            texts = []
            for t, spans in zip(batch.column(at), batch.column(place), strict=True):
                if spans.is_valid:
                    raw, end, kept = t.as_py().encode(), 0, []
                    inside = K.GRAPHIC[np.frombuffer(raw, np.uint8)]
                    starts, ends = K.spans(inside, np.array([0, len(raw)]))
                    for s in spans.as_py():
                        kept.append(raw[end : starts[s["first_word"]]])
                        end = ends[s["end_word"] - 1]
                    texts.append(b"".join([*kept, raw[end:]]).decode())
                else:
                    texts.append(t.as_py())
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(columns) if i != place], names=names)

    return joined.mapInArrow(K.task(run), schema)
