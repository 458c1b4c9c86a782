"""Spelling variants, prefix trie and page extraction (11 to 13) against brute force."""

import collections
import hashlib
import random
import re
import time
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import extraction, prefix_trie, queries, shared, spelling

# 11


def spelled(rows, slip=199, letters=6, least=5, ratio=5):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= letters:
                counts[w] += 1
    n = {w: c for w, c in counts.items() if c >= least}
    holes = collections.defaultdict(set)
    for w in n:
        holes[w].add((w, -1))
        for k in range(len(w)):
            holes[w[:k] + w[k + 1 :]].add((w, k))
    near = collections.defaultdict(set)
    for group in holes.values():
        for a, i in group:
            near[a] |= {b for b, j in group if a != b and (i == j or -1 in (i, j))}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= ratio * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (n[w], len(near[w]), form.get(w), n.get(form.get(w)), root)
    return out


def by_word(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_op11(spark, sf, texts):
    want = spelled(texts.items())
    got = queries.op11_spelling_variants(spark, sf)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert by_word(got) == want and sum(w[1] for w in want.values()) > 0


def family(seed):
    """Words of few letters, so that anagrams, shifts and repeated letters abound."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé÷") for _ in range(rng.randint(6, 9))) for _ in range(400)]
    return [(i, " ".join(w for w in words for _ in range(rng.choice([1, 2, 30, 1])))) for i in range(5)]


@pytest.mark.parametrize("seed", [1, 2])
def test_anagrams_and_runs_of_one_letter(spark, seed):
    rows = [*family(seed), (None, "aaaaaa aaaaaaa " * 9 + "x " + "aaaaaaaa " * 99), (7, None), (8, ""), (9, "É" * 4000 + " 12 " + "Abcdefg." * 6), (9, "Abcdefg." * 6)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    for slip in (0, 3, 199):
        assert by_word(spelling.variants(df, rules=spelling.Rules(slip=slip))) == spelled(rows, slip)


def test_chains_of_forms_and_no_rows(spark):
    rows = [(1, "aaaaaa " * 5 + "aaaaab " * 25 + "aaaabb " * 125 + "aaabbb " * 625 + "aabbbb " * 3125 + "zzzzzzz " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_word(spelling.variants(df, rules=spelling.Rules(slip=0)))
    assert got == spelled(rows, 0) and got["aaaaaa"][4] == "aabbbb" and got["zzzzzzz"] == (5, 0, None, None, "zzzzzzz")
    assert spelling.variants(df.limit(0)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "single words only")], "doc_id long, text string")).count() == 0


def test_checksums_of_any_length():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 9000).astype(np.uint8)
    starts = rng.integers(0, 8000, 300)
    lengths = np.concatenate((rng.integers(1, 90, 299), [1000]))
    before = rng.integers(0, 1 << 32, 300).astype(np.uint32)
    want = [zlib.crc32(data[s : s + n].tobytes(), int(b)) for s, n, b in zip(starts, lengths, before, strict=True)]
    assert spelling.checksums(data, starts, lengths, before).tolist() == want


def test_spelling_broadcasts_no_table(spark, sf):
    """Compressed words look small to Spark; their keys in memory are not."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = shared.written(spelling.count_words(docs), "spelling-test")
    for df in (spelling.near_pairs(words), spelling.variants(docs)):
        df.count()
        plan = df._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_spelling_of_one_very_long_text():
    word = "abcdefgh "
    text = np.frombuffer((word * (30_000_000 // len(word))).encode(), np.uint8)
    tracemalloc.start()
    words, counts = spelling.chunk_words(text, np.array([0, len(text)]), [b"1:"], spelling.Rules())
    assert tracemalloc.get_traced_memory()[1] < 60 * len(text)
    tracemalloc.stop()
    assert words.to_pylist() == ["abcdefgh"] and counts.to_pylist() == [len(text) // len(word)]


# 12


def trie_of(rows, group=5, most=9):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, whole = collections.defaultdict(list), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = tuple(own.get(c - c % group, [])[:h] + turns[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    kids = collections.defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        m = members[k]
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(m) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in kids[k])
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


TURNS = "conv_id long, turn long, role string, text string"


def in_order(df):
    return sorted(map(tuple, df.collect()))


def test_op12(spark, sf):
    rows = [tuple(r) for r in queries.read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got, want = in_order(queries.op12_prefix_trie(spark, sf)), trie_of(rows)
    assert got == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted(con.execute(queries.OP12_SQL).fetchall()) == want


def deep(seed):
    rng = random.Random(seed)
    return [(c, t, "u" if t < 7 or rng.random() < 0.7 else "a", rng.choice(["é", "xy"]) if rng.random() < 0.15 else "x") for c in range(250) for t in range(rng.choice([0, 1, 2, 3, 4, 9, 12]))]


@pytest.mark.parametrize("blocks", [1, 6, 40])
def test_trie_over_any_number_of_blocks(spark, blocks):
    for rows in (deep(blocks), [(c, t, "u", "x") for c in range(60) for t in range(4)]):
        assert in_order(prefix_trie.prefix_nodes(spark.createDataFrame(rows, TURNS), blocks=blocks)) == trie_of(rows)


def test_trie_of_odd_rows(spark):
    rows = [(0, 0, None, "a"), (0, None, "u", None), (0, 1, "", ""), (1, 1, "", ""), (1, 1, "", ""), (None, 0, "u", "lost"), (13, 0, "u", "x"), (20, 5, "u", "y"), (21, 5, "u", "y"), (10**15, 0, "u", "x")]
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], TURNS + ", depth long, kind string")
    for blocks in (1, 4):
        assert in_order(prefix_trie.prefix_nodes(df, blocks=blocks)) == trie_of(rows)
    assert prefix_trie.prefix_nodes(df.limit(0)).count() == 0


def test_trie_of_a_very_long_conversation(spark):
    one = spark.range(20000).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.lit("x").alias("text"))
    df = one.unionByName(one.withColumn("conv_id", F.lit(6).cast("long")).where("turn < 15000"))
    got = prefix_trie.prefix_nodes(df)
    r = got.agg(F.count("*"), F.max("depth"), F.sum("n_convs"), F.max("saved_tokens"), F.max("n_leaves")).collect()[0]
    assert tuple(r) == (20001, 20000, 20001 + 15001, 15000, 1)


def test_ids_of_one_node_pass_in_chunks(spark):
    rows = [(c, 0, "u", "x") for c in range(0, 3000, 5)]  # groups' first conversations: rebuilt as they are
    df = spark.createDataFrame(rows, TURNS)
    got = {r.depth: r for r in prefix_trie.prefix_nodes(df, blocks=16).collect()}
    assert got[1].ends_sha256 == hashlib.sha256(",".join(str(c) for c in range(0, 3000, 5)).encode()).hexdigest()
    assert (got[1].n_convs, got[1].n_leaves, got[1].saved_tokens, got[0].n_children) == (600, 1, 599, 1)


# 13

P = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."

PAGES = {
    "columns told by class, lists without end tags": (
        f'<div id="header"><h1>Site</h1><ul><li><a href=/>Home</a><li><a href=/b>About</a></ul></div><div id=wrap><h1>Title</h1><div class="content"><p>{P}<p>Short.<p>{P} &amp; more&nbsp;x<ul><li>one<li>two, three</ul>'
        f'<blockquote>Quote</blockquote></div><div class="sidebar"><p>{P}{P}{P}</p></div><div id="comments"><h3>2 comments</h3>{f"<p>{P}</p>" * 9}</div></div><div class=footer>foot</div>',
        ["Title", P, "Short.", f"{P} & more x", "one", "two, three", "Quote"],
    ),
    "elements with a meaning": (
        f'<body><header>Site header <nav>x</nav></header><main><article><header><h1>T</h1></header><p>{P}</p><aside>side</aside><form>Sub <input></form><p>b<script>x<p>y</script>c</p><table><tr><td>a<td>b</table>'
        f'<pre>x\n  y</pre><section class="comments"><article class="comment"><p>{P}</p></article></section><footer>by me</footer></article><div class="related"><p>{P}</p></div></main><footer>c</footer>',
        ["T", P, "bc", "a", "b", "x y"],
    ),
    "line breaks": (f'<div id=a>{P}<br>\n<br>{P}<br>tail</div><div class="cookie-notice">We use cookies, {P}</div>', [P, f"{P} tail"]),
    "sections alike": (f"<div id=main><div class=sec><h2>A</h2><p>{P}</p><p>{P}</p></div><div class=sec><h2>B</h2><p>tiny.</p></div><div class=ad-box>{P}</div></div>", ["A", P, P, "B", "tiny."]),
    "a menu without a name": (f"<div><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><p>{P}</p><p><a href=x>Source</a></p></div>", [P, "Source"]),
    "a wrapper named by what it holds": (f'<div class="layout has-sidebar with-ads"><div class=text><p>{P}</p><p>{P}</p></div><div class=sidebar>{P}</div></div>', [P, P]),
    "hidden, notices, forms, dialogs": (f'<article><p>{P}<p hidden>no<p style="display: none">no<div role=alert>no</div><p class="cookie-notice">no<form><label>no</label><textarea>no</textarea></form><dialog>no</dialog><noscript>no</noscript><p>yes</article>', [P, "yes"]),
    "a short marked article beside a long advert": (f'<div class="ad">{P}</div><article><h1>T &lt;b&gt;</h1><p><b>One.<br></article><footer>&copy; x</footer>', ["T <b>", "One."]),
    "markup that never ends": (f'<!-- <p>{P}</p> --><p title="a>b">{P} &lt;x&#62; &amp &nosuch; &#x20AC;</p><!-- never ends <p>x', [f"{P} <x> & &nosuch; €"]),
    "unclosed quotes and tags": (f'<p class="a>{P}</p><p>{P}', None),
    "nothing but furniture": ("<html><head><title>x</title></head><body><nav>a</nav><footer>b</footer></body></html>", []),
    "plain text": ("just text & more", ["just text & more"]),
    "white space": (f"<p>\n a\t\tb&#10;&#160;c  {P}　\n</p>", [f"a b c {P}"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    source, want = PAGES[name]
    got = extraction.main_blocks(source)
    assert got == want if want is not None else isinstance(got, list)


def test_articles_side_by_side():
    source = f"<main><article><p>{P}<p>{P}</article></main><div class=x><article><p>{P}</article><article><p>{P}<p>{P}<p>{P}</article></div>"
    assert extraction.main_blocks(source) == [P] * 4


def test_op13(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(con.execute(f"SELECT page_id, url, text, n_chars FROM ({queries.OP13_SQL})").fetchall())
    got = queries.op13_html_extraction(spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect())) == want


def test_pages_of_odd_rows(spark):
    rows = [(1, None, "k"), (2, "", "k"), (2, "", "k"), (None, f"<p>{P}", None)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert got.columns == ["page_id", "html", "text", "_text", "n_chars"]
    assert sorted((r._text, r.n_chars) for r in got.collect()) == [("", 0), ("", 0), ("", 0), (P, len(P))]
    assert extraction.extract(got.limit(0)).count() == 0


@pytest.mark.parametrize("unit", [f"<p>{P}</p>", "<div>", "<b>x", "<p>x", "</div>", "<a href='", "<!--", "<", "<li>a", "&amp", "x "])
def test_very_long_pages_take_time_in_proportion(unit):
    source = unit * (4_000_000 // len(unit))
    began = time.process_time()
    got = extraction.main_text(source)
    assert time.process_time() - began < 60
    if unit.startswith("<p>L"):
        assert got == "\n\n".join([P] * (len(source) // len(unit)))
