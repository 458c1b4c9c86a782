"""Operators on groups of rows against brute force (2, 3, 5, 9) and components."""

import base64
import collections
import hashlib
import itertools

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tessera.llm import chat, components, paragraphs, queries, simhash, warc
from tessera.llm.components import connected_components
from tessera.llm.shared import new_path
from tests.plans import small_partitions, split_joins

from .conftest import ODD, graphic, lower


def groups(pairs):
    """Smallest node reachable, by union-find."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up}


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5), (None, 1)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.id: r.component for r in connected_components(df, "a", "b").collect()}
    assert got == groups([p for p in pairs if None not in p and p[0] != p[1]])
    assert connected_components(df.limit(0), "a", "b").count() == 0


# 2


def pages(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string")


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 3000)
    rng = np.random.default_rng(1)
    data = [(k, f"http://h/{k}\r\né", rng.bytes(300).hex()) for k in range(60)] + [(100 + k, None, "same") for k in range(5)] + [(200, "u", None), (201, "u", ""), (None, "u", "same"), (None, "v", "alone")]
    df = pages(spark, data)
    folder = new_path(spark, "t-warc")
    index = warc.write(df, folder)
    got = {(r.page_id, r.payload_digest): r for r in warc.read(spark, folder).collect()}
    best = {}
    for i, _, h in data:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    for i, _, h in data:
        raw = (h or "").encode()
        r = got[i, base64.b32encode(hashlib.sha1(raw).digest()).decode()]
        head = best[h or ""]
        want = ("response", None) if i == head or head == -1 else ("revisit", head)
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(raw), *want)
    # each record is found by a seek to its frame, and a plain decompressor reads the whole bundle
    ids = index.where("page_id in (3, 57, 104)")
    for r in warc.fetch(ids, folder).collect():
        (_, headers, block), *more = warc.parse(bytes(r.record))
        assert headers["X-Page-ID"] == str(r.page_id) and not more and block.endswith((data[r.page_id][2] if r.page_id < 100 else "same").encode())
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).collect():
        table = warc.seek_table(bytes(r.content))
        whole = zstandard.ZstdDecompressor().decompressobj
        text = b"".join(whole().decompress(bytes(r.content)[s : s + p]) for s, p, _ in table)
        assert sum(n for _, _, n in table) == len(text) and len(table) >= 1
    assert warc.round_trip(df.limit(0)).count() == 0


def oracle(name, spark, sf, cols):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchdf()
    got = queries.queries()[name](spark, sf).toPandas()
    rows = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_op2_and_op5_against_sql(spark, sf):
    oracle("op2_warc_seekable", spark, sf, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    oracle("op5_chat_format", spark, sf, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


# 5


@pytest.mark.parametrize("text", ["", "<|", "<\\|x", "<|im_end|>\n<|im_start|>user\n", "<<|\\|", "plain", "\\n<\\\\|"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat._unrole(chat._role(text)) == text and "\n" not in chat._role(text)


class Verbose:
    """A black box that says at the end how many turns there were."""

    def __call__(self, messages):
        return "".join(f"[{r}] {t}\n" for r, t in messages) + f"({len(messages)})"


class Plain:
    def __call__(self, messages):
        return "".join(f"{'BOS' if k == 0 else ''}[{r}] {t}\n" for k, (r, t) in enumerate(messages))


def test_black_box_templates():
    spans = chat.Spans(Plain())
    turns = [("user", "a"), ("assistant", "[user] a\n"), ("user", "")]
    out = ""
    for r, t in turns:
        piece, a, b = spans.push(r, t)
        assert piece[a:b] == t
        out += piece
    assert out == Plain()(turns) and not spans.rewrites
    spans = chat.Spans(Verbose())
    assert not spans.rewrites and spans.push("user", "a")[1] >= 0
    assert spans.push("user", "b")[1] == -1 and spans.rewrites


class Forgetful:
    """Drops its first turn while it has ``at`` turns or more, up to ``until``."""

    def __init__(self, at, until=1 << 30):
        self.at, self.until = at, until

    def __call__(self, messages):
        return "".join(f"[{r}] {t}\n" for r, t in (messages[1:] if self.at <= len(messages) < self.until else messages))


@pytest.mark.parametrize("at", [6, 40, 700])
def test_rewrites_at_any_turn_are_flagged(spark, at):
    data = [(1, k, "assistant" if k % 2 else "user", f"text {k}") for k in range(at + 10)] + [(2, k, "assistant" if k % 2 else "user", f"text {k}") for k in range(at - 1)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = chat.format_turns(df, Forgetful(at)).collect()
    flags = [r.rewrites for r in got if r.conv_id == 1]
    assert flags == [False] * (at - 1) + [True] * 11
    assert not any(r.rewrites for r in got if r.conv_id == 2)
    last = max(k for k, r in enumerate(got) if r.conv_id == 1 and r.rewrites and r.piece.count("\n") > 1)
    rows = [r for r in got[last:] if r.conv_id == 1]
    assert "".join(r.piece for r in rows) == Forgetful(at)([(r, t) for _, _, r, t in data[: at + 10]])
    # a rewrite that the next turn undoes is one, too
    assert any(r.rewrites for r in chat.format_turns(df, Forgetful(at, at + 1)).where("conv_id = 1").collect())


class Trimmed:
    def __call__(self, messages):
        return "".join(f"[{r}] {t.strip()}\n" for r, t in messages)


def test_unplaced_texts_are_reported(spark):
    t = Trimmed()
    data = [(1, 0, "user", "a"), (1, 1, "assistant", "  "), (1, 2, "assistant", "b")]
    got = chat.format_turns(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"), t).collect()
    assert all(r.in_loss != r.unplaced for r in got if r.conv_id == 1 and "assistant" in r.piece)
    assert got[2].piece[got[2].text_start : got[2].text_end] == "b"


def test_chat_rows(spark):
    data = [(1, k, "assistant" if k % 2 else "user", f"text {k} <|im_end|>") for k in range(30)] + [(2, 0, "assistant", None), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (None, None, None, "x"), (3, 1, "as<|sistant\n", "y")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(0))
    t = chat.MarkedTurns()
    pieces = chat.format_turns(df, t)
    got = {r.conv_id: r for r in chat.read_back(pieces, t).collect()}
    by = collections.defaultdict(list)
    for c, k, r, x in data:
        by[c].append((-1 if k is None else k, r or "", x or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        g = got[c]
        loss = "".join(x for _, r, x in rows if r == "assistant")
        assert (g.n_turns, g.loss_chars, g.loss_sha256) == (len(rows), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest()
        assert g.formatted_chars == len(t([(r, x) for _, r, x in rows])) and not g.rewrites
    assert chat.read_back(chat.format_turns(df.limit(0), t), t).count() == 0


# 9


def fingerprint(text):
    w = graphic(lower(text))
    s = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints):
    """Component of each (id, fingerprint) at 4 or fewer differing bits."""
    by = collections.defaultdict(list)
    for i, f in prints:
        by[f].append(i)
    fs = np.array(list(by), np.uint64)
    near = np.argwhere(np.bitwise_count(fs[:, None] ^ fs[None]) <= 4)
    label = groups([(int(fs[a]), int(fs[b])) for a, b in near])
    least = {}
    for f, ids in by.items():
        real = [i for i in ids if i is not None]
        if real:
            least[label[f]] = min(least.get(label[f], 1 << 62), *real)
    return {f: least.get(label[f]) for f in by}


def test_xxh64():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    starts, lengths = rng.integers(0, 3000, 500), rng.integers(0, 200, 500)
    got = simhash.xxh64(data, starts, lengths)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), seed=42) for s, n in zip(starts, lengths, strict=True)]


def test_majority_over_many_shingles():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 255, 256, 1500, 2])
    h = rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64)
    cut = np.concatenate(([0], np.cumsum(counts)))
    want = [sum(1 << b for b in range(64) if 2 * int((h[a:z] >> np.uint64(b) & np.uint64(1)).sum()) > z - a) for a, z in zip(cut[:-1], cut[1:], strict=True)]
    assert simhash.majority(h, counts).tolist() == want


@pytest.mark.parametrize("direct", [simhash.DIRECT, 8])
def test_links_connect_what_brute_force_does(spark, monkeypatch, direct):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fs = list(base)
    for f in base[:10]:
        for _ in range(60):  # dense neighbourhoods make large buckets
            fs.append(f ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 9), replace=False))))
    fs = sorted({int(f) for f in fs})
    monkeypatch.setattr(simhash, "DIRECT", direct)
    i, j = simhash.link_bucket(np.array(fs, np.uint64), tuple(range(64)))
    near = np.argwhere(np.bitwise_count(np.array(fs, np.uint64)[:, None] ^ np.array(fs, np.uint64)[None]) <= 4)
    want = groups([(fs[a], fs[b]) for a, b in near])
    solo = [(f, f) for f in fs]
    assert groups([*solo, *((fs[a], fs[b]) for a, b in zip(i, j, strict=True))]) == want
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fs], "fp long")
    got = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(df).collect()]
    assert groups([*solo, *got]) == want


def test_op9_and_odd_rows(spark, sf, texts, odd):
    for rows, data in ((queries.op9_simhash_dedup(spark, sf).collect(), list(texts.items())), (None, ODD)):
        prints = [(i, fingerprint(t)) for i, t in data]
        comp = linked(prints)
        want = collections.Counter((i, f"{f:016x}", comp[f]) for i, f in prints)
        if rows is None:
            got = simhash.near_duplicates(odd.withColumn("fingerprint", F.lit(0)))
            rows = got.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id").collect()
        assert collections.Counter(map(tuple, rows)) == want


def test_deduplicate_keeps_one_of_each(spark, odd):
    kept = simhash.deduplicate(odd.withColumn("_own_id", F.lit("x")))
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    comp = linked([(i, fingerprint(t)) for i, t in ODD])
    assert max(got.values()) == 1 and len(got) == len({comp[fingerprint(t)] for _, t in ODD})
    assert (1, ODD[0][1]) in got and (5, ODD[0][1]) not in got
    assert simhash.deduplicate(odd.limit(0)).count() == 0


# 3


def passage(rng, n, tag="p"):
    return " ".join(f"{tag}{x}" for x in rng.integers(0, 10**6, n))


def repeated_words(data, size):
    """Documents that share a run of ``size`` words with another one."""
    seen = collections.defaultdict(set)
    for i, t in data:
        w = graphic(lower(t))
        for k in range(len(w) - size + 1):
            seen[tuple(w[k : k + size])].add(i)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}


@pytest.fixture(scope="module")
def shared_passages():
    rng = np.random.default_rng(4)
    mid, own, line = passage(rng, 51), passage(rng, 200), passage(rng, 60)
    words = line.split()
    words[30] = "changed"
    data = [(k, passage(rng, 150)) for k in range(20)]
    data += [(30 + k, f"{passage(rng, 70)} {mid} {passage(rng, 70)}") for k in range(4)]  # in the middle of a line
    data += [(40, f"{passage(rng, 30)}\n{own}"), (41, f"{own.upper()}\n{passage(rng, 30)}")]
    data += [(50, f"{passage(rng, 40)}\n{line}"), (51, f"{' '.join(words)}\n{passage(rng, 40)}")]  # a near copy of a line
    data += [(60 + k, f"one short line that all share\n{passage(rng, 60)}") for k in range(5)]
    return [*data, (70, None), (71, ""), (None, own), (80, "same " * 200)]


def test_passages(spark, shared_passages):
    df = spark.createDataFrame(shared_passages, "doc_id long, text string")
    got = {r.doc_id: r for r in paragraphs.find(df).collect()}
    assert set(got) == {i for i, _ in shared_passages if i is not None}
    hit = {i for i, r in got.items() if r.n_repeated}
    assert hit == {30, 31, 32, 33, 40, 41, 50, 51}
    assert {i for i, r in got.items() if r.removed_words} == {31, 32, 33, 41, 51}
    assert [got[i].class_id for i in (30, 31, 32, 33, 40, 41, 50, 51, 3)] == [30, 30, 30, 30, 40, 40, 50, 50, 3]


def test_removal(spark, shared_passages):
    df = spark.createDataFrame(shared_passages, "doc_id long, text string").withColumn("_cut", F.lit(1))
    left = [(r.doc_id, r.text) for r in paragraphs.remove(df).collect()]
    assert repeated_words([x for x in left if x[0] is not None], 50) == set()
    before, after = dict(shared_passages), dict(left)
    assert all(after[i] == t for i, t in shared_passages if i is not None and i not in (31, 32, 33, 41, 51))
    assert all(len(graphic(after[i])) < len(graphic(before[i])) for i in (31, 32, 33, 41, 51))
    assert after[None] == before[None]


def test_a_whole_copy_is_dropped_and_repeated_rows_stay(spark):
    rng = np.random.default_rng(6)
    t = passage(rng, 90)
    df = spark.createDataFrame([(1, t), (2, t), (3, t), (3, t), (4, passage(rng, 90)), (4, passage(rng, 90))], "doc_id long, text string")
    got = collections.Counter(r.doc_id for r in paragraphs.remove(df).collect())
    assert got[1] == 1 and got[4] == 2
    left = paragraphs.remove(df).where("doc_id in (2, 3)").collect()
    assert all(len(graphic(r.text)) < 36 for r in left)
    assert paragraphs.find(df.limit(0)).count() == 0


def test_every_long_repeat_is_found_in_the_table(spark, sf, texts):
    rows = {r.doc_id: r for r in queries.op3_paragraph_minhash(spark, sf).collect()}
    want = repeated_words(texts.items(), 50)
    hit = {i for i, r in rows.items() if r.n_repeated}
    assert want <= hit
    assert all(i in repeated_words(texts.items(), 20) for i in hit)


def test_bands_reach_the_recall():
    n = paragraphs.bands()
    assert 1 - (1 - paragraphs.THRESHOLD**paragraphs.ROWS) ** n >= paragraphs.RECALL
    rng = np.random.default_rng(8)
    found = 0
    for _ in range(60):
        w = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        v = w.copy()
        v[[25, 80]] = rng.integers(0, 1 << 63, 2, dtype=np.uint64)  # Jaccard 106 / 126
        both = np.concatenate((w, v))
        s = paragraphs.line_signatures(both, np.array([0, 120]), np.array([120, 240]), n)
        found += bool((s[0] == s[1]).any())
    assert found >= 57


def test_all_links_of_a_bucket_with_many_families(spark):
    rng = np.random.default_rng(12)
    common, data = passage(rng, 200).split(), []
    for f in range(40):
        w = list(common)
        for k in rng.choice(190, 4, replace=False):
            w[k] = f"f{f}x{k}"
        data += [(2 * f + copy, " ".join([*w[:-1], f"end{f}x{copy}"])) for copy in range(2)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("text_key", F.xxhash64("text")).select("doc_id", "text_key", "text")
    units = paragraphs.units(docs, paragraphs.bands()).where(F.col("kind") == paragraphs.PARAGRAPH)
    doc = {r.key: r.doc_id for r in units.collect()}
    got = collections.defaultdict(set)
    for r in paragraphs.paragraph_links(units, docs).collect():
        got[r.component].add(doc[r.key])
    assert sorted(map(sorted, got.values())) == [[2 * f, 2 * f + 1] for f in range(40)]


def shingles(text, n=5):
    w = graphic(lower(text))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def jaccard_groups(data, threshold=0.8):
    """Components of all pairs of texts at the threshold, those of one text left out."""
    sets = [(i, shingles(t)) for i, t in data]
    near = [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if len(a & b) >= threshold * len(a | b)]
    out = collections.defaultdict(list)
    for i, c in groups(near).items():
        out[c].append(i)
    return list(out.values())


def boilerplate(families, seed):
    """Families of two near copies (about 0.87), all alike by shared words (about 0.79)."""
    rng = np.random.default_rng(seed)
    common, data = passage(rng, 120).split(), []
    for f in range(families):
        w = list(common)
        for k in (5, 115):
            w[k] = f"f{f}x{k}"
        for copy in range(2):
            v = list(w)
            v[40 + 30 * copy] = f"c{f}x{copy}"
            data.append((2 * f + copy, " ".join(v)))
    return data


@pytest.mark.parametrize("group", [paragraphs.GROUP, 4000])
def test_no_link_among_boilerplate_is_lost(spark, group):
    data = boilerplate(150, 13)
    sets = [shingles(t) for _, t in data[:4]]
    share = lambda a, b: len(a & b) / len(a | b)
    assert share(sets[0], sets[1]) >= 0.8 > share(sets[0], sets[2])
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("text_key", F.xxhash64("text")).select("doc_id", "text_key", "text")
    units = paragraphs.units(docs, paragraphs.bands()).where(F.col("kind") == paragraphs.PARAGRAPH)
    doc = {r.key: r.doc_id for r in units.collect()}
    got = collections.defaultdict(list)
    for r in paragraphs.paragraph_links(units, docs, group=group).collect():
        got[r.component].append(doc[r.key])
    want = jaccard_groups(data)
    together = {frozenset(p) for g in got.values() for p in itertools.combinations(g, 2)}
    pairs = {frozenset(p) for g in want for p in itertools.combinations(g, 2)}
    assert together <= pairs and len(together) >= 0.99 * len(pairs)


def test_link_group_equals_all_pairs():
    rng = np.random.default_rng(14)
    for trial in range(30):
        base = [rng.choice(400, rng.integers(3, 60), replace=False) for _ in range(6)]
        sets = []
        for _ in range(rng.integers(2, 40)):
            b = set(base[rng.integers(6)].tolist())
            b |= {int(x) for x in rng.choice(4000, rng.integers(0, 8))}
            sets.append(np.array(sorted(b), np.int64))
        n = len(sets)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        near = [(i, j) for i, j in itertools.combinations(range(n), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        got = paragraphs.link_group(np.concatenate(sets), offsets, np.arange(n), np.ones(n, bool))
        solo = [(i, i) for i in range(n)]
        assert groups([*solo, *got]) == groups([*solo, *near])
        assert set(map(frozenset, got)) <= set(map(frozenset, near))
        # split over two blocks and a second pass from one side
        half = np.arange(n) % 2 == 0
        first = [*solo, *(p for p in got if half[p[0]] == half[p[1]])]
        label = np.zeros(n, np.int64)
        for i, c in groups(first).items():
            label[i] = c
        rest = paragraphs.link_group(np.concatenate(sets), offsets, label, np.ones(n, bool) if trial % 2 else label != np.bincount(label).argmax())
        assert groups([*first, *rest]) == groups([*solo, *near])
        pairs = [k for p in itertools.combinations(range(min(n, 8)), 2) for k in p]
        linked = paragraphs._link_pairs(np.concatenate([sets[k] for k in pairs]), np.concatenate(([0], np.cumsum([len(sets[k]) for k in pairs]))), 0.8)
        assert linked.tolist() == [(a, b) in near for a, b in zip(pairs[::2], pairs[1::2], strict=True)]


def test_near_paragraphs_of_the_table(spark, sf, texts):
    rows = {r.doc_id: r for r in queries.op3_paragraph_minhash(spark, sf).collect()}
    lines = collections.defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(graphic(line)) >= 5:
                lines[tuple(graphic(lower(line)))].add(i)
    keys = list(lines)
    number = {k: n for n, k in enumerate(keys)}
    holders = collections.defaultdict(list)
    for k in keys:
        for s in shingles(" ".join(k)):
            holders[s].append(number[k])
    sets = [shingles(" ".join(k)) for k in keys]
    tested = {p for h in holders.values() for p in itertools.combinations(sorted(h), 2)}
    near = [(a, b) for a, b in tested if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    component, held = groups([*((n, n) for n in range(len(keys))), *near]), collections.defaultdict(set)
    for n, c in component.items():
        held[c] |= lines[keys[n]]
    alike = {n for n, c in component.items() if len(held[c]) > 1}
    want = collections.Counter(i for i, t in texts.items() for line in (t or "").split("\n") if len(graphic(line)) >= 5 and number[tuple(graphic(lower(line)))] in alike)
    got = collections.Counter({i: r.n_similar for i, r in rows.items() if r.n_similar})
    assert sum((want & got).values()) >= 0.99 * sum(want.values()) and not got - want


def test_wrapped_paragraphs_meet(spark):
    rng = np.random.default_rng(15)
    w = passage(rng, 80).split()
    v = [*w[:40], "changed", *w[41:]]
    wrap = lambda x, n: "\n".join(" ".join(x[k : k + n]) for k in range(0, len(x), n))
    data = [(1, f"{passage(rng, 20)}\n\n{wrap(w, 9)}\n \n{passage(rng, 20)}"), (2, f"{passage(rng, 20)}\n\n\n{wrap(v, 13)}"), (3, f"{passage(rng, 20)}\n{' '.join(w[:39])} other {' '.join(w[40:])}")]
    got = {r.doc_id: r for r in paragraphs.find(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[k].class_id for k in (1, 2, 3)] == [1, 1, 1] and [got[k].removed_words for k in (1, 2, 3)] == [0, 80, 80]
    assert [got[k].n_paragraphs for k in (1, 2, 3)] == [3, 2, 2]


def test_removed_words_are_the_whole_runs(spark, sf, texts):
    found = {r.doc_id: r for r in paragraphs.find(spark.read.parquet(f"{sf}/documents.parquet"), min_words=10**6).collect()}
    seen, size = {}, paragraphs.RUN
    for i in sorted(texts):
        w = graphic(lower(texts[i]))
        for k in range(len(w) - size + 1):
            seen.setdefault(tuple(w[k : k + size]), i)
    for i, t in texts.items():
        w = graphic(lower(t))
        cut = {x for k in range(len(w) - size + 1) if seen[tuple(w[k : k + size])] != i for x in range(k, k + size)}
        assert {x for s in found[i].spans for x in range(s.first_word, s.end_word)} == cut
        assert found[i].removed_words == len(cut)
        raw = t.encode()
        for s in found[i].spans:
            assert graphic(raw[s.start_byte : s.end_byte].decode()) == graphic(t)[s.first_word : s.end_word]
            assert raw[s.start_byte : s.end_byte].strip(b" \t\n\r\v\f") == raw[s.start_byte : s.end_byte]
    assert any(r.removed_words for r in found.values())


def test_hot_payloads_and_components_can_be_split(spark):
    pages = spark.range(4000, numPartitions=8).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"), F.when(F.col("id") % 40 == 0, F.col("id").cast("string")).otherwise("").alias("html"))
    # numbers of 9 bits are one component, the others stand alone
    prints = spark.range(1000, numPartitions=8).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 512, F.col("id")).otherwise(F.xxhash64("id")).alias("fingerprint"))
    giant = spark.range(3000).select(F.lit(1).cast("long").alias("u"), (F.col("id") + 2).alias("v"))
    found = simhash.components(prints)
    assert found.where("component_id = 0").count() == 512
    with small_partitions(spark):
        assert split_joins(warc.revisits(pages)) >= 1
        assert split_joins(found) >= 1
        assert split_joins(components._hang(giant.unionByName(giant.selectExpr("v as u", "u as v")))) >= 1
