"""Operators on single texts against brute force (1, 4, 6, 7, 8, 10)."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, decontaminate, interpolation, language, licenses, queries, repetition
from tessera.llm import kernels as K

from .conftest import ODD, alnum, graphic, lower

RANKS = P.path("byte_bpe_50k.tiktoken")
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
ALPHABET = "'strevlmdS \n\t\r aZéß1٣½!$ 　​́漢😀\x1c\x85"


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.read_ranks(RANKS))


def encode(encoder, texts):
    out = []
    for lo, hi, data, offsets in K.chunks(pa.array(texts, pa.string())):
        ids, counts = encoder.encode(data, offsets)
        cut = np.concatenate(([0], np.cumsum(counts)))
        out += [ids[cut[i] : cut[i + 1]].tolist() for i in range(hi - lo)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=24), min_size=1, max_size=8))
def test_bpe_equals_tiktoken(encoder, texts):
    assert encode(encoder, texts) == [TIK.encode_ordinary(t) for t in texts]


def test_every_code_point_is_cut_as_tiktoken_cuts_it(encoder):
    """Letters end a word before a suffix, numbers and others stand apart, white
    space goes on: each code point between letters, before a suffix and a digit."""
    some = [*range(0xD800), *range(0xE000, 0x110000)]
    assert len(some) == 1_112_064
    for lo in range(0, len(some), 1 << 16):
        texts = [f"a{chr(c)}'s {chr(c)}1 {chr(c)}" for c in some[lo : lo + (1 << 16)]]
        assert encode(encoder, texts) == TIK.encode_ordinary_batch(texts, num_threads=2)


def test_bpe_long_pieces_and_small_cache(encoder, monkeypatch):
    texts = ["a" * 4000, "ab" * 900, "'" * 300, " " * 700 + "x", "", "<|endoftext|>"]
    assert encode(encoder, texts) == [TIK.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "CACHE", 3)
    assert encode(encoder, ["one two three four five six"] * 2) == [TIK.encode_ordinary("one two three four five six")] * 2


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(ALPHABET + "  \n\u00a0\u3000"), max_size=60), st.integers(4, 9))
def test_slices_of_a_long_text_have_its_tokens(encoder, text, size):
    raw = np.frombuffer(text.encode(), np.uint8)
    before, byte_bpe.CHUNK = byte_bpe.CHUNK, size
    try:
        cut = byte_bpe.slices(raw)
        assert [a for a, _ in cut] == [0, *(b for _, b in cut)][: len(cut)] and (not cut or cut[-1][1] == len(raw))
        ids, counts = encoder.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == TIK.encode_ordinary(text) and counts.tolist() == [len(ids)]
        assert encoder.decode(ids).tobytes() == text.encode()
    finally:
        byte_bpe.CHUNK = before


def test_scan_equals_the_machine_run_in_order():
    rng = np.random.default_rng(0)
    tape = rng.integers(0, 9, 5000).astype(np.uint8)
    state, want = byte_bpe.ENDED, []
    for s in tape:
        want.append(state)
        state = byte_bpe._step(state, int(s))[0]
    assert byte_bpe.scan_states(tape).tolist() == want


def test_bpe_round_trip_and_offsets(odd):
    df = odd.withColumn("ids", F.lit("taken")).withColumn("n", F.monotonically_increasing_id())
    got = byte_bpe.encode(df, RANKS)
    assert got.columns == ["doc_id", "text", "ids", "n", "_ids", "token_starts"]
    back = byte_bpe.decode(got.withColumn("kept", F.col("_ids")).withColumn("at", F.col("token_starts")), RANKS, ids="_ids")
    for r in back.collect():
        ids = np.frombuffer(bytes(r.kept), "<u4").tolist()
        assert ids == TIK.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
        starts = np.frombuffer(bytes(r["at"]), "<u4").tolist()
        sizes = [len(TIK.decode_single_token_bytes(i)) for i in ids]
        assert starts == np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(int).tolist() if ids else starts == []


def test_bpe_round_trip_in_one_task(odd):
    df = odd.withColumn("ids", F.lit("taken")).withColumn("token_starts", F.lit(1)).withColumn("decoded", F.lit(None))
    got = byte_bpe.round_trip(df.withColumn("same", F.col("text")), RANKS)
    assert got.columns == ["doc_id", "ids", "token_starts", "decoded", "same", "_ids", "_decoded"]
    for r in got.collect():
        assert np.frombuffer(bytes(r._ids), "<u4").tolist() == TIK.encode_ordinary(r.same or "") and bytes(r._decoded) == (r.same or "").encode()
    assert byte_bpe.round_trip(odd.limit(0), RANKS).count() == 0


def test_op10(spark, sf, texts):
    for r in queries.op10_byte_bpe(spark, sf).collect():
        ids = TIK.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


# 1


def fold(i):
    return {2: 2, 3: 1}.get(zlib.crc32(str(i).encode()) % 7, 0) if i is not None else 0


def check_scores(rows, data, model):
    words = [(i, [*graphic(lower(t)), None]) for i, t in data]
    uni, big, heads = collections.Counter(), collections.Counter(), 0
    for i, w in words:
        if fold(i) != 2:
            uni.update(w)
            big.update(zip([0, *w[:-1]], w, strict=True))
            heads += 1
    n, v = sum(uni.values()), len(uni)
    assert (model.n, model.v) == (n, v)
    want = []
    for i, w in words:
        score, before = 0.0, 0
        for x in w:
            c = heads if before == 0 else uni[before]
            b = int(math.log2(c + 1))
            a, u, z = model.weights[:, b]
            score += math.log10((a * big[before, x] / c if c else 0) + u * uni[x] / n + z / (v + 1))
            before = x
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        want.append((str(i), fold(i) == 2, len(w), sum(uni[x] > 0 for x in w), n, round(base, 4), round(score, 4)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in rows) == sorted(want)


@pytest.mark.parametrize("block", [interpolation.BLOCK_BYTES, 20_000])
def test_interpolation_equals_counting_by_hand(docs, texts, monkeypatch, block):
    monkeypatch.setattr(interpolation, "BLOCK_BYTES", block)
    rows = docs.select("doc_id", "text").withColumn("fold", interpolation.folds("doc_id"))
    counted = interpolation.count(rows, "doc_id", "text", "fold").persist()
    model = interpolation.fit(counted)
    np.testing.assert_allclose(model.weights.sum(axis=0), 1)
    check_scores(interpolation.score(counted, model).collect(), texts.items(), model)
    counted.unpersist()


def test_interpolation_odd_rows(odd):
    counted = interpolation.count(odd.withColumn("fold", interpolation.folds("doc_id")), "doc_id", "text", "fold").persist()
    model = interpolation.fit(counted)
    check_scores(interpolation.score(counted, model).collect(), ODD, model)
    assert interpolation.learn_and_score(odd.limit(0)).collect() == []
    counted.unpersist()


def test_interpolation_beats_the_base_on_held_out_texts(spark, sf):
    r = queries.op1_deleted_interpolation(spark, sf).where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert r.s > r.b


def test_em_finds_the_better_estimate(spark):
    rows = [(k, "a b a b a b a b", k % 2) for k in range(40)]
    counted = interpolation.count(spark.createDataFrame(rows, "i long, t string, f int"), "i", "t", "f").persist()
    m = interpolation.fit(counted)
    bucket = int(math.log2(80 + 1))
    assert m.weights[0, bucket] > 0.8
    counted.unpersist()


# 4


def brute_blocks(text, template, threshold):
    """Greatest containment over all runs of words, or 0: that of the whole text."""
    own = set(template.split())
    shared = len(own & set(alnum(text)))
    return shared / len(own) if shared >= math.ceil(threshold * len(own) - 1e-9) else 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=24), st.integers(1, 6))
def test_reported_blocks_are_the_best_that_do_not_overlap(tokens, needed):
    places = np.arange(len(tokens)) * 3 + 1
    got = licenses.blocks(places, np.array(tokens, np.int64), needed)
    every = [(i, j, len(set(tokens[i : j + 1]))) for i in range(len(tokens)) for j in range(i, len(tokens))]
    mine = [((a - 1) // 3, (b - 1) // 3, n) for a, b, n in got]
    assert all(len(set(tokens[a : b + 1])) == n >= needed for a, b, n in mine)
    assert all(x[1] < y[0] for x, y in zip(mine, mine[1:], strict=False))
    for i, j, n in every:  # whatever meets the template overlaps a report that shares as much
        if n >= needed:
            assert any(a <= j and i <= b and m >= min(n, m) for a, b, m in mine)
            assert any(m >= n for _, _, m in mine)


def test_licenses_equal_brute_force(spark):
    notice = list(licenses.TEMPLATES)
    rng = np.random.default_rng(1)
    data = []
    for k in range(60):
        lines = []
        for _ in range(3):
            w = notice[rng.integers(len(notice))].split()
            keep = [x for x in w if rng.random() > 0.06] + ["zu"] * int(rng.integers(3))
            if rng.random() < 0.5:
                rng.shuffle(keep)
            step = int(rng.integers(3, 200))
            lines += [" ".join(keep[a : a + step]) for a in range(0, len(keep), step)] + [""] * int(rng.integers(2))
        data.append((k, "\n".join(lines).upper()))
    data += [(100, "CC-BY, cc by; GNU General\nPublic License. All rights\treserved"), (101, None), (102, ""), (102, "cc by"), (103, "released under\n" * 40 + "the mit license")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("matches", F.lit(1))
    for t in (0.6, licenses.THRESHOLD, 1.0):
        got, phrases = collections.Counter(), collections.Counter()
        for r in licenses.find(df, threshold=t).collect():
            for m in r._matches:
                if m.base:
                    phrases[r.doc_id, m.label] += 1
                else:
                    got[r.doc_id, m.label] = max(got[r.doc_id, m.label], round(m.containment, 9))
        want, want_phrases = collections.Counter(), collections.Counter()
        for i, text in data:
            for n, label in licenses.TEMPLATES.items():
                if best := brute_blocks(text, n, t):
                    want[i, label] = max(want[i, label], round(best, 9))
            w = alnum(text)
            for p, label in licenses.PHRASES.items():
                n = sum(w[k : k + len(p.split())] == p.split() for k in range(len(w)))
                if n:
                    want_phrases[i, label] += n
        assert got == want and phrases == want_phrases


HEADERS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
 of this software and associated documentation files (the "Software"), to deal
 in the Software without restriction, including without limitation the rights""",
    "gpl-3.0": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.""",
    "bsd": """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are met:""",
    "apache-2.0": """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at""",
    "mpl-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */""",
}


def test_wrapped_notices_are_found(spark):
    rng = np.random.default_rng(2)
    other = "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 999, 9)) for _ in range(30))
    df = spark.createDataFrame([(k, f"{other}\n{v}\n{other}") for k, v in HEADERS.items()] + [("none", other)], "name string, text string")
    got = {r.name: {m.label for m in r.matches} for r in licenses.find(df).collect()}
    assert got.pop("none") == set()
    assert all(k in labels for k, labels in got.items())


@pytest.mark.parametrize("n", [0, 25, 5000])
def test_notices_among_any_number_of_words(spark, n):
    rest = "wort " * n
    df = spark.createDataFrame([(1, f"{rest}released under the\n{rest}mit license{rest}"), (2, f"{rest}released under the\nmit license {rest}"), (3, f"released under the mit {rest}")], "doc_id long, text string")
    got = {r.doc_id: [(m.label, m.last_word - m.first_word) for m in r.matches] for r in licenses.find(df).collect()}
    assert got[2] == [("mit", 4)] and got[3] == [] and (n > 0 or got[1] == [("mit", 4)])
    assert licenses.find(df.limit(0)).count() == 0


def test_no_templates_no_matches(spark):
    df = spark.createDataFrame([(1, "cc by the mit license")], "doc_id long, text string")
    assert licenses.scan(df, licenses.index({}, {}, {})).first().matches == []


def test_op4(spark, sf, texts):
    for r in queries.op4_license_setjoin(spark, sf).collect():
        w = alnum(texts[r.doc_id])
        places = [(k, label) for k in range(len(w)) for p, label in licenses.PHRASES.items() if w[k : k + len(p.split())] == p.split()]
        firsts = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(firsts, default=None), max(firsts, default=None), ",".join(sorted({x for _, x in places})))
        met = {label: best for n, label in licenses.TEMPLATES.items() if (best := brute_blocks(texts[r.doc_id], n, licenses.THRESHOLD))}
        assert r.labels == ",".join(sorted({x for _, x in places} | set(met)))
        assert r.score == pytest.approx(1.0 if places else max((brute_blocks(texts[r.doc_id], n, licenses.THRESHOLD) for n in licenses.TEMPLATES), default=0))


# 6


def test_language_id(spark, sf, docs):
    got = queries.op6_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_held_out_rows_are_not_learned_from(spark, tmp_path, docs):
    """Other texts and labels in held-out rows change no prediction elsewhere."""
    cold = [r.doc_id for r in docs.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    rows = {}
    for k, df in enumerate((docs, docs.withColumn("text", F.when(F.col("doc_id").isin(cold), "zzz qqq " * 50).otherwise(F.col("text"))).withColumn("lang", F.when(F.col("doc_id").isin(cold), "xx").otherwise(F.col("lang"))))):
        df.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        rows[k] = {r.doc_id: r for r in queries.op6_language_id(spark, f"{tmp_path}/{k}").collect()}
    assert {i for i, r in rows[0].items() if r.held_out} == set(cold) and len(cold) > 10
    assert all(r == rows[1][i] for i, r in rows[0].items() if not r.held_out)
    assert "xx" not in {r.lang_pred for r in rows[1].values()}


def test_slices_of_a_text_have_its_ngrams(monkeypatch):
    raw = np.frombuffer("The quick bröwn 漢字 fox, and more. ".encode() * 9, np.uint8)
    for offsets in ([0, len(raw)], [0, 0, 3, 4, 50, len(raw), len(raw)]):
        cut = np.array(offsets)
        want = language.gram_counts(raw, cut)
        for size in (1, 2, 7, 64):
            monkeypatch.setattr(language, "SLICE", size)
            assert (language.gram_counts(raw, cut) == want).all()
        monkeypatch.undo()
    monkeypatch.setattr(language, "SLICE", 5)
    some = ["1 2 ... ¿¡ " * 3 + "é", "1234567 漢", "١٢٣ ½ ¿¿¿¿¿¿", "", "12345x"]
    data, cut = K.buffers(pa.array(some))
    assert language.has_letter(data, cut).tolist() == [True, True, False, False, True]


def brute_grams(text):
    """Buckets of all n-grams of 1 to 4 bytes, by plain integers."""
    low, out, most = lower(text).encode(), collections.Counter(), (1 << 32) - 1
    for n in (1, 2, 3, 4):
        for i in range(len(low) - n + 1):
            gram = 0
            for byte in low[i : i + n]:
                gram = (gram * 257 + byte + 1) & most
            h = (gram ^ (n * 0x9E3779B1 & most)) * 0x85EBCA6B & most
            h = (h ^ (h >> 15)) * 0xC2B2AE35 & most
            out[h >> 17] += 1
    return out


def test_language_equals_brute_force(spark, docs):
    some = docs.where("doc_id < 40").select("doc_id", F.substring("text", 1, 400).alias("text"), "lang").collect()
    data = [(r.doc_id, r.text, r.lang) for r in some] + [(100, None, "en"), (101, "abc", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.fit(df)
    seen = collections.defaultdict(collections.Counter)
    for _, t, lang in data:
        if t is not None and lang is not None:
            seen[lang] += brute_grams(t)
    names = sorted(seen)
    assert model.languages == tuple(names)
    p = {lang: {b: (c[b] + 0.5) / (c.total() + 0.5 * language.BUCKETS) for b in range(language.BUCKETS)} for lang, c in seen.items()}
    splits = range(1, 1 << (len(names) - 1)) if 1 < len(names) <= 6 else None
    assert splits is not None
    code = {lang: [1 if s >> k & 1 else -1 for s in splits] for k, lang in enumerate(names)}
    odds = []
    for s in range(len(splits)):
        plus, minus = [lang for lang in names if code[lang][s] > 0], [lang for lang in names if code[lang][s] < 0]
        odds.append({b: math.log(sum(p[x][b] for x in plus) / len(plus)) - math.log(sum(p[x][b] for x in minus) / len(minus)) for b in range(language.BUCKETS)})
    weights = [max(min(code[x][s] * sum(p[x][b] * o[b] for b in o) for x in names), 0.02) for s, o in enumerate(odds)]
    weights = [w / sum(weights) for w in weights]
    for r in language.predict(df, model).collect():
        grams = brute_grams(r.text or "")
        if not any(c.isalpha() for c in r.text or ""):
            assert r.lang_pred == "und"
            continue
        margins = [sum(n * o[b] for b, n in grams.items()) / grams.total() for o in odds]
        loss = {x: sum(w * math.log1p(math.exp(-language.SCALE * m * c)) for w, m, c in zip(weights, margins, code[x], strict=True)) for x in names}
        near = {x: math.exp((min(loss.values()) - v) * len(weights)) for x, v in loss.items()}
        best = min(names, key=lambda x: (loss[x], x))
        assert r.lang_pred == best and abs(r.score - near[best] / sum(near.values())) < 1e-3
        assert r.ambiguous == (sorted(near.values())[-2] >= language.NEAR * near[best])


def test_language_odd_rows(odd, docs):
    model = language.fit(docs)
    rows = language.predict(odd.withColumn("score", F.lit(0)), model).collect()
    by = [(r.text, r.lang_pred, r._score) for r in rows]
    assert all((p == "und" and s == 0) == (t is None or not any(c.isalpha() for c in t)) for t, p, s in by)
    assert all(0 <= s <= 1 for _, _, s in by)
    none = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.predict(odd, none).collect()} == {"und"}
    one = language.fit(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in language.predict(odd.where("doc_id = 1"), one).collect()} == {"en"}


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20, 100])
def test_codewords_are_apart(n):
    c = language.codewords(n)
    d = (c[:, None] != c[None]).sum(-1) + np.eye(n, dtype=int) * 999
    assert d.min() >= max(1, c.shape[1] // 2 - 1) if n > 2 else d.min() >= 1


def test_ambiguity_is_flagged(docs):
    model = language.fit(docs)
    halves = docs.where("lang in ('en', 'fr')").groupBy("lang").agg(F.max_by("text", "n_chars").alias("t"))
    a, b = [r.t[:2000] for r in halves.collect()]
    spark = docs.sparkSession
    both = " ".join(x + " " + y for x, y in zip(a.split(), b.split(), strict=False))
    rows = language.predict(spark.createDataFrame([(both,), (a,)], "text string"), model).collect()
    assert rows[1].score >= rows[0].score and not rows[1].ambiguous


# 7


def brute_repeats(words):
    n = len(words)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                best[i] = max(best[i], k)
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=4))
def test_repeat_lengths(texts):
    flat = [w for t in texts for w in t]
    h = np.array([K.hash_bytes(w.encode()) for w in flat], np.uint64)
    sizes = np.array([len(t) for t in texts])
    got = repetition.repeat_lengths(h, np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes))
    assert got.tolist() == [x for t in texts for x in brute_repeats(t)]


def base_counts(t):
    t = t or ""
    w = graphic(t)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if graphic(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(hit)


def in_repeats(w, size):
    """Places in windows of so many words that occur twice or more."""
    seen = collections.defaultdict(list)
    for k in range(len(w) - size + 1):
        seen[tuple(w[k : k + size])].append(k)
    return {k + j for places in seen.values() if len(places) > 1 for k in places for j in range(size)}


def test_op7_and_odd_rows(spark, sf, texts, odd):
    for r in queries.op7_suffix_repetition(spark, sf).collect():
        want = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        rules, w = repetition.Rules(), graphic(texts[r.doc_id])
        covered, longest = len(in_repeats(w, rules.min_repeat)), 0
        while in_repeats(w, longest + 1):
            longest += 1
        assert (r.n_long_repeat_words, r.longest_repeat) == (covered, longest)
        bad = covered > rules.max_covered * len(w) or longest > max(rules.max_longest, rules.max_longest_share * len(w))
        assert r.kept == (not r.base_failed and not bad)
    for r in repetition.measure(odd.withColumn("n_words", F.lit(None))).collect():
        assert (r._n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(r.text)
    assert repetition.measure(odd.limit(0)).count() == 0


def test_verdict_on_repeats(spark):
    rng = np.random.default_rng(3)
    fresh = [f"w{x}" for x in rng.integers(0, 10**9, 400)]
    block = [f"v{x}" for x in rng.integers(0, 10**9, 130)]
    data = [("clean", fresh), ("block", fresh[:200] + block + fresh[200:300] + block), ("loops", fresh[:100] + fresh[:20] * 4)]
    df = spark.createDataFrame([(n, " ".join(w)) for n, w in data], "name string, text string")
    got = {r.name: r.ok for r in repetition.measure(df).withColumn("ok", repetition.accepted()).collect()}
    assert got == {"clean": True, "block": False, "loops": False}


# 8


def brute_hits(items, text):
    w, hit, ids = alnum(text), set(), set()
    for i, t in items:
        own = alnum(t)
        size = min(13, len(own))
        found = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(w)):
            if size and tuple(w[k : k + size]) in found:
                hit |= set(range(k, k + size))
                ids.add(i)
    return len(w), len(hit), ids


@pytest.mark.parametrize("most", [1 << 20, 700])
def test_decontamination(spark, most):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(40)] + ["é", "7"]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(k, text(int(rng.integers(1, 40)))) for k in range(30)] + [(50, None), (51, "..."), (52, "W1  w2-w3"), (52, "w1 w2 w3"), (53, "w1 w2 w3")]
    docs = [(k, text(60)) for k in range(10)] + [(20 + k, f"{text(20)} {items[k][1].upper()}, {text(20)}") for k in range(30)] + [(90, None), (91, ""), (92, items[3][1]), (None, "zz W1, W2 .w3")]
    b = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("taken")).withColumn("hit_one", F.lit("kept"))
    for r in decontaminate.find(df, b, automaton_bytes=most, filter_bits=1 << 16).collect():
        n, hit, ids = brute_hits(items, r.text)
        spans = [tuple(s) for s in r.hit_spans]
        assert r.hit_one == "kept" and r.n_words == "taken"
        assert r._n_words == n and sum(e - s for s, e, _, _ in spans) == hit and sorted(r.hit_items, key=str) == sorted(ids, key=str)
        raw = (r.text or "").encode()
        for s, e, x, y in spans:
            assert alnum(raw[x:y].decode()) == alnum(r.text)[s:e]
        assert all(p[1] < q[0] for p, q in zip(spans, spans[1:], strict=False))


def test_op8(spark, sf, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = collections.defaultdict(set)
    for i, t in items:
        own = alnum(t)
        size = min(13, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            windows[tuple(own[k : k + size])].add(i)
    sizes = {len(w) for w in windows}
    seen = 0
    for r in queries.op8_decontamination(spark, sf).collect():
        w, marked, ids = alnum(texts[r.doc_id]), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    ids |= found
                    marked |= set(range(k, k + size))
        n, hit = len(w), len(marked)
        seen += 1
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), hit > 0 and 20 * hit >= n)
    assert seen == len(texts)


def test_decontamination_odd_rows(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {len(r.hit_spans) for r in decontaminate.find(odd, none).collect()} == {0}
    word = spark.createDataFrame([(1, "word word")], "item_id long, text string")
    assert decontaminate.find(odd, word).where("doc_id = 7").select(decontaminate.n_hit()).first()[0] == 30000


def test_counts_of_any_size_keep_their_value():
    sizes = [np.array([2, 3]), np.array([1, 0, 2]), np.array([1])]
    counts = [np.array([7, 0xFFFFFFFF, 0, 255, 256], np.uint64), np.array([1 << 33, 3, (1 << 52) + 1], np.uint64), np.array([0], np.uint64)]
    rows = pa.concat_arrays([interpolation._planes(c, s) for c, s in zip(counts, sizes, strict=True)])
    assert interpolation._unplanes(rows, np.concatenate(sizes)).tolist() == np.concatenate(counts).tolist()
    none = pa.array([b"", *rows[:1].to_pylist()], pa.binary())
    assert interpolation._unplanes(none, np.array([4, 2])).tolist() == [7, 0xFFFFFFFF]


def test_block_counts_above_32_bits_are_added_up():
    key = interpolation._pack_keys(np.array([5, 9], np.uint64))
    most = interpolation._pack(np.array([0xFFFFFFFF, 1], np.uint32))
    rows = [(0, block, interpolation.KEYS, key, most, most, key, most, most) for block in range(3)]
    got = [r for b in interpolation._answers([interpolation._sent(rows)]) for r in b.to_pylist()]
    assert [interpolation._unpack(r["a"], np.uint64).tolist() for r in got if r["kind"] == interpolation.ANSWER] == [[3 * 0xFFFFFFFF, 3]] * 3


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace as Obj

    from tessera.llm import shared

    conf = Obj(get=lambda *_: None, set=lambda *_: None)
    cluster = Obj(conf=conf, sparkContext=Obj(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError, match=r"checkpoint\.dir"):
        shared.shared_dir(cluster)
