"""License scans by an exact set-similarity join of text blocks and templates.

A template is the word set of a license notice.  A block is any run of a text's
words, over lines and of any length, that begins and ends with a template's
token; blocks with containment |block & template| / |template| >= threshold meet
it.  Reported are the shortest blocks with the most shared tokens, then those
with fewer that do not overlap them, down to the threshold; a match has its
block's first and last word, so that users may ask for dense ones.

Tokens are put in one global order, rarest first, by their frequency over all
texts.  A template must share one of its first |T| - ceil(t |T|) + 1 tokens with
any such block, so only these prefixes are indexed; a text with too few tokens
(length filter) or with too few left after the shared one (positional filter)
has no such block and is passed over.  In what remains two pointers over the
places of the template's tokens find the blocks.
Phrases are templates whose words must stand consecutively, in order.

Only template words matter, so both passes keep a bounded vocabulary; the
templates and their token counts are all that is broadcast.

Defined results: null and empty texts have no words, no match and score 0; a
template that a text meets in several blocks counts once in its labels; equal
frequencies are ordered by the token; without templates and phrases nothing
matches.  Rows are independent, repeated ones included; other columns stay, and
output columns get underscores where a name is taken.  A very long text is held
whole by one task, with some 45 bytes a byte of text.  An empty
table gives no rows.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import fresh

THRESHOLD = 0.9
#: Phrases whose words must stand consecutively, and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License notices and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this library is free software you can redistribute it under the terms of the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "creative commons attribution 4 0 international": "cc-by-4.0",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "released into the public domain under cc0 1 0 universal": "cc0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "released under the bsd license": "bsd",
    "distributed under the boost software license version 1 0": "bsl-1.0",
    "copyright all rights reserved no part may be reproduced without permission": "reserved",
    # whole notices, as they head files
    """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
    documentation files the software to deal in the software without restriction including without limitation the rights
    to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to
    whom the software is furnished to do so subject to the following conditions the above copyright notice and this
    permission notice shall be included in all copies or substantial portions of the software""": "mit",
    """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
    license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable
    law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties
    or conditions of any kind either express or implied see the license for the specific language governing permissions
    and limitations under the license""": "apache-2.0",
    """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
    license as published by the free software foundation either version 3 of the license or at your option any later
    version this program is distributed in the hope that it will be useful but without any warranty without even the
    implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more
    details""": "gpl-3.0",
    """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
    license as published by the free software foundation either version 2 of the license or at your option any later
    version this program is distributed in the hope that it will be useful but without any warranty without even the
    implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more
    details""": "gpl-2.0",
    """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general
    public license as published by the free software foundation either version 2 1 of the license or at your option any
    later version this library is distributed in the hope that it will be useful but without any warranty""": "lgpl",
    """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general
    public license as published by the free software foundation either version 3 of the license or at your option any
    later version""": "agpl",
    """redistribution and use in source and binary forms with or without modification are permitted provided that the
    following conditions are met redistributions of source code must retain the above copyright notice this list of
    conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this
    list of conditions and the following disclaimer in the documentation and or other materials provided with the
    distribution""": "bsd",
    """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
    distributed with this file you can obtain one at http mozilla org mpl 2 0""": "mpl-2.0",
    """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
    provided that the above copyright notice and this permission notice appear in all copies""": "isc",
    """this software is provided as is without any express or implied warranty in no event will the authors be held liable
    for any damages arising from the use of this software permission is granted to anyone to use this software for any
    purpose including commercial applications and to alter it and redistribute it freely""": "zlib",
    """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
    compile sell or distribute this software""": "unlicense",
}


@dataclass(frozen=True)
class Index:
    """Templates as sets of token ranks (0: rarest) and the prefixes' postings."""

    tokens: tuple[str, ...]
    order: np.ndarray
    needed: np.ndarray
    sets: np.ndarray
    postings: tuple[tuple[int, int, int], ...]
    labels: tuple[str, ...]
    phrases: tuple[tuple[tuple[int, ...], str], ...]


def vocabulary(templates: dict[str, str], phrases: dict[str, str]) -> tuple[str, ...]:
    return tuple(sorted({w for t in (*templates, *phrases) for w in t.split()}))


def _ids(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all words, vocabulary number of each or -1)."""
    lower = K.LOWER[data]
    starts, ends = K.spans(K.ALNUM[lower], offsets)
    h = K.span_hashes(lower, starts, ends)
    if not len(keys):
        return starts, np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return starts, np.where(keys[at] == h, order[at], -1)


def _keys(tokens: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    h = np.array([K.hash_bytes(t.encode()) for t in tokens], np.uint64)
    order = np.argsort(h)
    return h[order], order


def frequencies(df: DataFrame, text: str, tokens: tuple[str, ...]) -> dict[str, int]:
    """How often each token of the vocabulary occurs over all texts."""
    keys, order = _keys(tokens)

    def run(batches):
        total = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column(0)):
                _, ids = _ids(data, offsets, keys, order)
                total += np.bincount(ids[ids >= 0], minlength=len(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tokens), dtype=np.int32)), pa.array(total)], names=["token", "n"])

    found = df.select(text).mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {t: 0 for t in tokens} | {tokens[r.token]: r.n for r in found}


def index(counts: dict[str, int], templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> Index:
    """Templates in the global order of tokens, with their prefixes indexed."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    tokens = tuple(sorted(counts, key=lambda t: (counts[t], t)))  # rarest first: number = rank
    rank = {t: k for k, t in enumerate(tokens)}
    sets, needed, postings = np.zeros((len(templates), len(tokens)), bool), [], []
    for k, t in enumerate(templates):
        own = sorted({rank[w] for w in t.split()})
        sets[k, own] = True
        least = math.ceil(threshold * len(own) - 1e-9)
        needed.append(least)
        postings += [(r, k, place) for place, r in enumerate(own[: len(own) - least + 1])]
    return Index(tokens, _keys(tokens)[1], np.array(needed, np.int64), sets, tuple(sorted(postings)), tuple(templates.values()), tuple((tuple(rank[w] for w in p.split()), label) for p, label in phrases.items()))


def join_blocks(block: np.ndarray, token: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, template, containment) of all pairs at the threshold.  ``block``
    and ``token`` are the distinct vocabulary tokens of blocks, sorted."""
    none = np.zeros(0, np.int64)
    if not len(block):
        return none, none, np.zeros(0)
    first = K.runs(block)
    sizes = np.diff(np.append(first, len(block)))
    number = np.repeat(np.arange(len(first)), sizes)
    after = sizes[number] - (np.arange(len(block)) - first[number])  # tokens of the block from this one on
    if not ix.postings:
        return none, none, np.zeros(0)
    rank, template, place = np.array(ix.postings, np.int64).reshape(-1, 3).T
    lo, hi = np.searchsorted(rank, token), np.searchsorted(rank, token, "right")
    hit = K.ranges(lo, hi - lo)
    b, t = np.repeat(number, hi - lo), template[hit]
    size = ix.sets.sum(axis=1)
    left = np.minimum(np.repeat(after, hi - lo), size[t] - place[hit])
    # tokens before this one in both orders may match as well: at most the shared prefix
    before = np.minimum(sizes[b] - np.repeat(after, hi - lo), place[hit])
    some = (sizes[b] >= ix.needed[t]) & (left + before >= ix.needed[t])
    pairs = np.unique(b[some] * len(size) + t[some])
    b, t = pairs // len(size), pairs % len(size)
    incidence = np.zeros((len(first), ix.sets.shape[1]), bool)
    incidence[number, token] = True
    shared = (incidence[b] & ix.sets[t]).sum(axis=1)
    good = shared >= ix.needed[t]
    return block[first][b[good]], t[good], shared[good] / size[t[good]]


def windows(token: list[int], shared: int) -> list[tuple[int, int]]:
    """(first, last) of the runs of places with ``shared`` distinct tokens that
    lose one if they begin later or end sooner."""
    out, seen, i = [], {}, 0
    for j, t in enumerate(token):
        seen[t] = seen.get(t, 0) + 1
        while seen[token[i]] > 1 or len(seen) > shared:
            seen[token[i]] -= 1
            if not seen[token[i]]:
                del seen[token[i]]
            i += 1
        if len(seen) == shared and (not out or out[-1][0] != i):
            out.append((i, j))
    return out


def blocks(word: np.ndarray, token: np.ndarray, needed: int) -> list[tuple[int, int, int]]:
    """(first word, last word, shared tokens) of the blocks of one text that meet
    a template, given the places of its tokens in order."""
    place, tokens, taken = word.tolist(), token.tolist(), []
    for shared in range(len(set(tokens)), needed - 1, -1):
        for first, last in sorted(windows(tokens, shared), key=lambda w: (place[w[1]] - place[w[0]], w[0])):
            at = bisect.bisect(taken, (first,))
            if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or taken[at][0] > last):
                taken.insert(at, (first, last, shared))
    return [(place[first], place[last], shared) for first, last, shared in taken]


MATCH = T.StructType([T.StructField("label", T.StringType(), False), T.StructField("base", T.BooleanType(), False), T.StructField("first_word", T.LongType(), False), T.StructField("last_word", T.LongType(), False), T.StructField("containment", T.DoubleType(), False)])


def scan(df: DataFrame, ix: Index, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``n_words`` and ``matches``: every place of a phrase (``base``) and
    every block that meets a template, with the first and the last word they share."""
    n_words, matches = fresh(df, "n_words"), fresh(df, "matches")
    schema = T.StructType([*(f for f in df.schema.fields if keep_text or f.name != text), T.StructField(n_words, T.LongType()), T.StructField(matches, T.ArrayType(MATCH, False))])
    at, columns = df.columns.index(text), schema.names
    shared = df.sparkSession.sparkContext.broadcast(ix)
    kind = pa.list_(pa.field("element", pa.struct([pa.field("label", pa.string(), False), pa.field("base", pa.bool_(), False), pa.field("first_word", pa.int64(), False), pa.field("last_word", pa.int64(), False), pa.field("containment", pa.float64(), False)]), False))

    def run(batches):
        ix = shared.value
        keys, order = _keys(ix.tokens)
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(at)):
                starts, ids = _ids(data, offsets, keys, order)
                bounds = np.searchsorted(starts, offsets)
                found: list[list] = [[] for _ in range(hi - lo)]
                known = np.flatnonzero(ids >= 0)
                for words, label in ix.phrases:
                    first = known[ids[known] == words[0]]
                    owner = np.searchsorted(bounds, first, "right") - 1
                    fits = first + len(words) <= bounds[owner + 1]
                    first, owner = first[fits], owner[fits]
                    for k, w in enumerate(words[1:], 1):
                        same = ids[first + k] == w
                        first, owner = first[same], owner[same]
                    for f, d in zip(first.tolist(), owner.tolist(), strict=True):
                        found[d].append({"label": label, "base": True, "first_word": f - int(bounds[d]), "last_word": f - int(bounds[d]) + len(words) - 1, "containment": 1.0})
                if len(known):
                    owner = np.searchsorted(bounds, known, "right") - 1
                    pair = np.unique(owner * len(ix.tokens) + ids[known])
                    texts, templates, _ = join_blocks(pair // len(ix.tokens), pair % len(ix.tokens), ix)
                    for d, t in zip(texts.tolist(), templates.tolist(), strict=True):
                        a, b = int(bounds[d]), int(bounds[d + 1])
                        own = known[np.searchsorted(known, a) : np.searchsorted(known, b)]
                        own = own[ix.sets[t][ids[own]]]
                        size = int(ix.sets[t].sum())
                        for first, last, common in blocks(own - a, ids[own], int(ix.needed[t])):
                            found[d].append({"label": ix.labels[t], "base": False, "first_word": first, "last_word": last, "containment": common / size})
                rows = [c for i, c in enumerate(batch.slice(lo, hi - lo).columns) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(np.diff(bounds)), pa.array(found, kind)], names=columns)

    return df.mapInArrow(run, schema)


def find(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """Counts token frequencies over all texts, then scans all texts."""
    return scan(df, index(frequencies(df, text, vocabulary(TEMPLATES, PHRASES)), threshold=threshold), text, keep_text)
