"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are cut without a regular expression.  Every code point gets a class; a
small Mealy machine over the classes says where pieces begin.  Its transition
functions form a finite monoid, so the machine runs as an associative scan:
blocks compose their functions column by column, block results are chained,
and each position then knows the state before it.  The pieces, as byte slices,
feed a merge cache; the start of every token in the text's bytes is retained,
and decoding scatters each token's bytes to these offsets.

Defined results: a null text is the empty text (no tokens, empty bytes); empty
texts give empty arrays; strings of special tokens are ordinary text.  Rows are
independent, so ties, repeats and null keys need no rule; all other columns are
kept, and output columns get leading underscores where a name is taken.  A very
long text is encoded and decoded by one task, in slices that begin where a piece
does, with some 30 bytes a byte of text; one without any single space or line end
between other characters is one slice.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import fresh

#: Pieces longer than this many bytes are merged one by one with a heap, and not cached.
LONG_PIECE = 96
#: At so many pieces the cache becomes the old one, whose pieces return when met again.
CACHE = 40_000
#: Bytes of texts, or of ids, worked on at a time.
CHUNK = 1 << 20
#: No rank.
NONE = 1 << 60

# classes of code points
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
#: What the classes are in the pattern's terms, and every code point that texts may have.
PROPERTIES = ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s"))
CODE_POINTS = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every code point, as the pattern's own engine has it: an
    encoding of single bytes returns just what a pattern matches.  (Interpreters
    and other engines know other versions of Unicode.)"""
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in PROPERTIES:
        engine = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[K.codepoints(np.array(engine.encode_ordinary(CODE_POINTS), np.uint8))] = kind
    table[0x20] = SPACE
    return table


# symbols: a class with what little of the text ahead matters
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_INNER, S_LAST_WHITE, S_LAST_SPACE, S_BEGIN = range(9)
# states: what the piece so far allows
IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, AFTER_SPACE, ONE_LEFT, TWO_LEFT, ENDED = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether the symbol begins a piece)."""
    if symbol == S_BEGIN:
        return ENDED, False
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return ENDED, False
    if symbol in (S_QUOTE1, S_QUOTE2):  # a suffix such as 's, unless the quote goes on with a piece
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER, False
        return (ONE_LEFT if symbol == S_QUOTE1 else TWO_LEFT), True
    if symbol in (S_LETTER, S_NUMBER, S_OTHER):
        own = (IN_LETTERS, IN_NUMBERS, IN_OTHER)[symbol]
        return own, state not in (own, AFTER_SPACE)
    if symbol == S_INNER:
        return IN_WHITE, state != IN_WHITE
    return (AFTER_SPACE if symbol == S_LAST_SPACE else ENDED), True  # the last white space before text stands alone


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, composition table, functions as state arrays, begins[state, symbol])."""
    n_states, n_symbols = 8, 9
    basic = [tuple(_step(s, y)[0] for s in range(n_states)) for y in range(n_symbols)]
    known = {tuple(range(n_states)): 0}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in basic:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    functions = sorted(known, key=known.get)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    begins = np.array([[_step(s, y)[1] for y in range(n_symbols)] for s in range(n_states)])
    return np.array([known[f] for f in basic], np.uint16), compose, np.array(functions, np.uint8), begins


def scan_states(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """The state before each symbol, by an associative scan of transition functions."""
    of_symbol, compose, functions, _ = _monoid()
    n = len(symbols)
    rows = -(-n // width)
    f = np.zeros(rows * width, np.uint16)
    f[:n] = of_symbol[symbols]
    f = np.ascontiguousarray(f.reshape(rows, width).T)
    flat, m = compose.ravel(), len(compose)
    before = np.zeros_like(f)  # within a row, the composition of what stands to the left
    acc = np.zeros(rows, np.uint16)
    for k in range(width):
        before[k] = acc
        acc = flat[acc.astype(np.int32) * m + f[k]]
    shift = 1  # inclusive scan of the rows' functions
    while shift < rows:
        acc[shift:] = flat[acc[:-shift].astype(np.int32) * m + acc[shift:]]
        shift *= 2
    entry = np.full(rows, ENDED, np.uint8)
    entry[1:] = functions[acc[:-1], ENDED]
    return functions.ravel()[before.astype(np.int32) * functions.shape[1] + entry].T.reshape(-1)[:n]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces begin, over a chunk of texts."""
    cps = K.codepoints(data)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(cps)
    kinds = class_table()[cps]
    ends = np.searchsorted(lead, offsets[1:])  # in code points
    last = np.zeros(n + 1, bool)
    last[ends] = True
    last = last[1:]  # position i is the last of its text
    following = np.full(n + 2, 255, np.uint32)
    following[:n] = cps
    nxt, nxt2 = following[1 : n + 1].copy(), following[2 : n + 2].copy()
    nxt[last] = 0
    nxt2[last] = 0
    nxt2[:-1][last[1:]] = 0
    white = kinds >= SPACE
    text_ahead = np.zeros(n, bool)
    text_ahead[:-1] = ~white[1:]
    text_ahead[last] = False
    symbols = np.where(white, np.where(text_ahead, np.where(kinds == SPACE, S_LAST_SPACE, S_LAST_WHITE), S_INNER), kinds).astype(np.uint8)
    quotes = np.flatnonzero(cps == 0x27)
    a, b = nxt[quotes], nxt2[quotes]
    symbols[quotes[np.isin(a, [ord(c) for c in "stmd"])]] = S_QUOTE1
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    symbols[quotes[two]] = S_QUOTE2
    # a begin mark before each text resets the machine
    first = np.searchsorted(lead, offsets[:-1])
    tape = np.insert(symbols, first, S_BEGIN)
    states = scan_states(tape)
    begins = _monoid()[3].ravel()[states.astype(np.int32) * 9 + tape]
    keep = np.ones(len(tape), bool)
    keep[first + np.arange(len(first))] = False
    return lead[begins[keep]]


def slices(data: np.ndarray) -> list[tuple[int, int]]:
    """Slices of one text, of CHUNK bytes and what it takes to the next place where
    a piece begins whatever else the text has: a single space or line end between
    two characters that are not white."""
    found, lo = [], 0
    while lo < len(data):
        hi = min(len(data), lo + CHUNK)
        while hi < len(data):
            some = data[hi : hi + CHUNK]
            places = (hi + np.flatnonzero((some == 0x20) | (some == 0x0A))).tolist()
            near = ((p, data[p - 4 : p].tobytes().decode(errors="ignore")[-1:], data[p + 1 : p + 5].tobytes().decode(errors="ignore")[:1]) for p in places)
            cut = next((p for p, a, b in near if a and b and max(class_table()[ord(a)], class_table()[ord(b)]) < SPACE), None)
            if cut is not None:
                hi = cut
                break
            hi = min(len(data), hi + CHUNK)
        found.append((lo, hi))
        lo = hi
    return found


def read_ranks(path: str) -> bytes:
    """A rank file's bytes, read where it lies, that is on the driver."""
    with open(path, "rb") as f:
        return f.read()


class Decoder:
    """The tokens of a rank file, end to end in one array."""

    def __init__(self, rank_file: bytes):
        tokens = {int(b): base64.b64decode(a) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        size = max(tokens) + 1
        self.lengths = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)

    def decode(self, ids: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
        """The bytes of ids, each token's put at its start (by default end to end)."""
        if not len(ids):
            return np.zeros(0, np.uint8)
        if starts is None:
            starts = np.cumsum(self.lengths[ids]) - self.lengths[ids]
        out = np.zeros(int(starts[-1] + self.lengths[ids[-1]]), np.uint8)
        for lo in range(0, len(ids), CHUNK):
            some = ids[lo : lo + CHUNK]
            lengths = self.lengths[some]
            out[K.ranges(starts[lo : lo + CHUNK], lengths)] = self.bytes[K.ranges(self.places[some], lengths)]
        return out


class Encoder(Decoder):
    """Merges of pieces under a rank file, with a bounded cache of pieces."""

    def __init__(self, rank_file: bytes):
        super().__init__(rank_file)
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        splits = {(self.ranks[t[:k]] << 32 | self.ranks[t[k:]]): i for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self.pair_keys = np.array(sorted(splits), np.int64)
        self.pair_ids = np.array([splits[k] for k in sorted(splits)], np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece: the pair of lowest rank first, the leftmost of equals."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        return self._merge_long(piece)

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair of ids merges to, or NONE."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], NONE)

    def _merge_equal(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of one length, merged side by side, one merge of each a round."""
        size = len(pieces[0])
        tokens = self.single[np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), size)]
        out: list[bytes] = [b""] * len(pieces)
        rows = np.arange(len(pieces))
        ranks = self._ranks_of(tokens[:, :-1], tokens[:, 1:])
        while True:
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            alive = ranks[np.arange(len(rows)), best] != NONE if ranks.shape[1] else np.zeros(len(rows), bool)
            if not alive.all():
                done = np.flatnonzero(~alive)
                for r, t in zip(rows[done].tolist(), tokens[done].astype("<u4"), strict=True):
                    out[r] = t.tobytes()
                rows, tokens, ranks, best = rows[alive], tokens[alive], ranks[alive], best[alive]
            if not len(rows):
                return out
            n, k = tokens.shape
            each = np.arange(n)
            tokens[each, best] = ranks[each, best]
            cols = np.arange(k - 1)[None, :]
            tokens = np.take_along_axis(tokens, cols + (cols > best[:, None]), 1)
            if k > 2:
                cols = np.arange(k - 2)[None, :]
                ranks = np.take_along_axis(ranks, cols + (cols >= best[:, None]), 1)
                left, right = np.flatnonzero(best > 0), np.flatnonzero(best < k - 2)
                ranks[left, best[left] - 1] = self._ranks_of(tokens[left, best[left] - 1], tokens[left, best[left]])
                ranks[right, best[right]] = self._ranks_of(tokens[right, best[right]], tokens[right, best[right] + 1])
            else:
                ranks = ranks[:, :0]

    def learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids (little-endian unsigned 32-bit integers) of pieces that the cache lacks."""
        if len(self.cache) + len(pieces) > CACHE:
            self.old, self.cache = self.cache, {}
        by_length: dict[int, list[bytes]] = {}
        for p in pieces:
            by_length.setdefault(len(p), []).append(p)
        new: dict[bytes, bytes] = {}
        for size, group in by_length.items():
            if size > LONG_PIECE:
                new |= {p: np.array(self.merge(p), "<u4").tobytes() for p in group}
                continue
            whole = [p for p in group if p in self.ranks]
            rest = [p for p in group if p not in self.ranks]
            for lo in range(0, len(rest), max(1, (1 << 19) // size)):
                some = rest[lo : lo + max(1, (1 << 19) // size)]
                new |= zip(some, self._merge_equal(some), strict=True)
            new |= {p: self.ranks[p].to_bytes(4, "little") for p in whole}
            self.cache |= {p: new[p] for p in group}
        return new

    def _merge_long(self, piece: bytes) -> list[int]:
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # of the part that begins here; 0: merged away
        left = list(range(-1, n - 1))

        def rank(i: int) -> int:
            j = end[i]
            return ranks.get(piece[i : end[j]], -1) if j < n else -1

        heap = [(r, i) for i in range(n - 1) if (r := rank(i)) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not end[i] or rank(i) != r:
                continue
            j = end[i]
            end[i], end[j] = end[j], 0
            if end[i] < n:
                left[end[i]] = i
                if (x := rank(i)) >= 0:
                    heapq.heappush(heap, (x, i))
            if left[i] >= 0 and (x := rank(left[i])) >= 0:
                heapq.heappush(heap, (x, left[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens of each text) of a chunk of texts; a text longer than a
        chunk is encoded in slices."""
        if len(offsets) > 2 or len(data) <= CHUNK:
            return self._encode(data, offsets)
        ids = np.concatenate([self._encode(data[lo:hi], np.array([0, hi - lo]))[0] for lo, hi in slices(data)])
        return ids, np.array([len(ids)])

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        _, first, kind = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        found = list(map(self.cache.get, pieces))
        if None in found:
            for i, (p, f) in enumerate(zip(pieces, found, strict=True)):
                if f is None and (f := self.old.get(p)) is not None:
                    found[i] = self.cache[p] = f
            new = self.learn([p for p, f in zip(pieces, found, strict=True) if f is None])
            found = [f or new[p] for p, f in zip(pieces, found, strict=True)]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        places = np.cumsum(lengths) - lengths
        counts = lengths[kind]
        ids = np.frombuffer(b"".join(found), "<u4")[K.ranges(places[kind], counts)]
        total = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


#: The encoder or decoder of a worker process and the rank file it is of.
_kept: dict[int, Decoder] = {}


def _of(kind: type, rank_file) -> Decoder:
    """An encoder serves as a decoder as well."""
    key = hash(rank_file.value)
    if not isinstance(_kept.get(key), kind):
        _kept.clear()
        _kept[key] = kind(rank_file.value)
    return _kept[key]


def _extended(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t, True) for n, t in fields)])


def _encoded(encoder: Encoder, batches, at: int, keep_text: bool, names: list[str]):
    """Batches with the ids and offsets of the texts in column ``at``."""
    for batch in batches:
        for lo, hi, data, offsets in K.chunks(batch.column(at), CHUNK):
            got, counts = encoder.encode(data, offsets)
            ends = np.cumsum(encoder.lengths[got])
            begin = ends - encoder.lengths[got] - np.repeat(offsets[:-1], counts)
            columns = [c for i, c in enumerate(batch.slice(lo, hi - lo).columns) if keep_text or i != at]
            columns += [K.binary_column(got.view(np.uint8), counts * 4), K.binary_column(begin.astype("<u4").view(np.uint8), counts * 4)]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    encoder.old = {}


def _decoded(decoder: Decoder, batches, at: int, place: int | None, kept: list[int], names: list[str]):
    """Batches with the bytes of the packed ids in column ``at``."""
    for batch in batches:
        for lo, hi, data, offsets in K.chunks(batch.column(at), CHUNK):
            rows = batch.slice(lo, hi - lo)
            got = np.frombuffer(data.tobytes(), "<u4")
            lengths = decoder.lengths[got]
            sums = np.concatenate(([0], np.cumsum(lengths)))
            sizes = np.diff(sums[offsets // 4])
            begin = None
            if place is not None:
                begin = np.frombuffer(K.buffers(rows.column(place))[0].tobytes(), "<u4").astype(np.int64) + np.repeat(np.cumsum(sizes) - sizes, np.diff(offsets // 4))
            columns = [rows.column(i) for i in kept]
            yield pa.RecordBatch.from_arrays([*columns, K.binary_column(decoder.decode(got, begin), sizes)], names=names)


def encode(df: DataFrame, rank_path: str, text: str = "text", ids: str = "ids", starts: str = "token_starts", keep_text: bool = True) -> DataFrame:
    """Adds ``ids`` and ``token_starts``: token ids and the byte offsets in the
    UTF-8 text at which they begin, both as packed little-endian uint32.

    The rank file is read on the driver and broadcast; a vocabulary's size is
    fixed and does not grow with the data.
    """
    rank_file = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    ids, starts = fresh(df, ids), fresh(df, starts)
    schema = _extended(df, (ids, T.BinaryType()), (starts, T.BinaryType()))
    if not keep_text:
        schema = T.StructType([f for f in schema.fields if f.name != text])
    at, names = df.columns.index(text), schema.names
    return df.mapInArrow(K.task(lambda batches: _encoded(_of(Encoder, rank_file), batches, at, keep_text, names)), schema)


def decode(df: DataFrame, rank_path: str, ids: str = "ids", starts: str | None = "token_starts", out: str = "decoded", drop: bool = True) -> DataFrame:
    """Adds ``decoded``: the bytes of packed ``ids``, placed by ``token_starts``
    if given.  A null or empty id array decodes to empty bytes.  ``drop`` leaves
    the two packed columns out."""
    rank_file = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    out = fresh(df, out)
    gone = {ids, starts} if drop else set()
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in gone), T.StructField(out, T.BinaryType())])
    at, place = df.columns.index(ids), df.columns.index(starts) if starts else None
    kept = [i for i, c in enumerate(df.columns) if c not in gone]
    names = schema.names
    return df.mapInArrow(K.task(lambda batches: _decoded(_of(Decoder, rank_file), batches, at, place, kept, names)), schema)


def round_trip(df: DataFrame, rank_path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` without its texts, with their ids and the bytes these decode to:
    ``decode(encode(df))`` in one task, so that one worker holds the tables."""
    rank_file = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    ids, out = fresh(df, ids), fresh(df, out)
    schema = T.StructType([f for f in _extended(df, (ids, T.BinaryType()), (out, T.BinaryType())).fields if f.name != text])
    at, names = df.columns.index(text), schema.names
    n = len(names) - 1
    middle, kept = [*names[:-1], fresh(df, "token_starts")], list(range(n))

    def run(batches):
        coder = _of(Encoder, rank_file)
        yield from _decoded(coder, _encoded(coder, batches, at, False, middle), n - 1, n, kept, names)

    return df.mapInArrow(K.task(run), schema)


def n_tokens(ids: Column) -> Column:
    """The number of tokens in a packed array."""
    return (F.octet_length(ids) / 4).cast("long")
