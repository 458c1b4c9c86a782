"""Vectorised text kernels over Arrow string buffers, shared by the operators.

Texts stay in Arrow's UTF-8 buffer; a kernel sees one chunk of whole texts as a
byte array with offsets.  A chunk has at most ``CHUNK`` bytes unless one single
text is longer, so memory is bounded by the longest text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = (2 << 20) - 64

U64 = np.uint64
_K1, _K2, _K3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

#: Maps A-Z to a-z and every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+ .
GRAPHIC = np.ones(256, bool)
GRAPHIC[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, a-z and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def trim() -> None:
    """Gives free memory back to the system, for workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL(None).malloc_trim(0)


def task(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task body that trims when it ends."""

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole texts."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run never crosses a text's end."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < len(inside)]] = False
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def bounds(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n + 1 indices into ``starts``: where the items of each text begin."""
    return np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * _K2
    h ^= h >> U64(27)
    h *= _K3
    h ^= h >> U64(31)
    return h


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit values, in order."""
    return mix(a * _K1 + mix(b + _K3))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _K1)
_R = 0xD1342543DE82EF95
_R_INV = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, r in enumerate((_R, _R_INV)):
            out = np.full(size, U64(r), U64)
            out[0] = 1
            _powers[k] = np.cumprod(out, dtype=U64)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans by one prefix sum over the chunk.

    Equal spans get equal hashes at any place; distinct ones collide with a
    probability of about 2**-64 a pair.
    """
    if not len(starts):
        return np.zeros(0, U64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    terms = _BYTE[data]
    terms *= power[: len(data)]
    np.cumsum(terms, out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(U64) * _K1)


def hash_bytes(word: bytes) -> int:
    """``span_hashes`` of one whole string."""
    data = np.frombuffer(word, np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive items, at each place where n items follow."""
    out = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        out = pair(out, h[k : len(h) - n + 1 + k])
    return out


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """arange(s, s + n) for each s and n, joined."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def binary_column(data: np.ndarray, lengths: np.ndarray, kind=None) -> pa.Array:
    """A binary or string column over one joined byte array."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    kind = kind or pa.binary()
    if pa.types.is_binary(kind) or pa.types.is_string(kind):
        offsets = offsets.astype(np.int32)
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def codepoints(data: np.ndarray) -> np.ndarray:
    """The code points of UTF-8 bytes; what isn't UTF-8 counts as U+FFFD."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
