"""Words of many texts at once, as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+``. Words are known by 64-bit hashes of their
UTF-8 bytes: a polynomial hash from one running sum over all bytes, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(int(_P), -1, 2**64))
_Q = U(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Texts are taken in slices of about this many bytes, to bound the arrays.
SLICE = 1 << 20

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        one = np.full(max(n, SLICE + (SLICE >> 1)), _P, U)
        inv = np.full(len(one), _P_INV, U)
        one[0] = inv[0] = 1
        _powers = np.multiply.accumulate(one), np.multiply.accumulate(inv)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64; a bijection."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def ascending(x: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers that are not negative. Numbers are sorted with their
    places as one number each, much faster than places by number; of those that are too long
    for that only the high bits, and all of them the plain way where that left two out of order."""
    if not len(x):
        return np.zeros(0, np.int64)
    x = x.astype(U, copy=False)
    bits = max(len(x) - 1, 1).bit_length()
    off = max(0, int(x.max()).bit_length() + bits - 64)
    key = x >> U(off)
    key <<= U(bits)
    key |= np.arange(len(x), dtype=U)
    key.sort()
    key &= U((1 << bits) - 1)
    at = key.view(np.int64)
    if off:
        y = x[at]
        if (y[1:] < y[:-1]).any():
            return np.argsort(x, kind="stable")
    return at


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, none negative, in order, and the place of each among them."""
    at = ascending(x)
    y = x[at]
    new = np.ones(len(x), bool)
    new[1:] = y[1:] != y[:-1]
    place = np.empty(len(x), np.int64)
    place[at] = np.cumsum(new) - 1
    return y[new], place


def strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, col: str = "text") -> Iterator[pa.RecordBatch]:
    """Row ranges of the batch with about SLICE bytes of text each, one row at least."""
    _, off = strings(batch.column(batch.schema.get_field_index(col)))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(off, off[at] + SLICE, "right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on beside other operators' workers."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


@dataclass
class Words:
    data: np.ndarray  # all bytes
    off: np.ndarray  # byte offsets of the texts
    start: np.ndarray  # byte range of each word
    end: np.ndarray
    at: np.ndarray  # words of text i are at[i]:at[i+1]
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes."""
    n = len(data)
    one, inv = _tables(n)
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTES[data] * one[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * inv[start]
    return mix(h ^ (end - start).astype(U))


def words(col: pa.Array, lower: bool = False) -> Words:
    data, off = strings(col)
    if lower:
        data = _LOWER[data]
    n = len(data)
    sep = _SEP[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = edge[:-1].copy()
    before[1:] |= sep[:-1]
    after = edge[1:].copy()
    after[:-1] |= sep[1:]
    np.logical_not(sep, out=sep)
    start = np.flatnonzero(sep & before)
    end = np.flatnonzero(sep & after) + 1
    return Words(data, off, start, end, np.searchsorted(start, off), hashes(data, start, end))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each text, and their offsets by text.

    Window j of text i is at ``offsets[i] + j``.
    """
    h, total = w.hash, len(w.hash)
    many = np.maximum(np.diff(w.at) - (n - 1), 0)
    at = np.concatenate([[0], np.cumsum(many)])
    if not at[-1]:
        return np.zeros(0, U), at
    acc = np.full(total - n + 1, U(n))
    for j in range(n):
        acc = acc * _Q + h[j : total - n + 1 + j]
    first = np.repeat(w.at[:-1] - at[:-1], many) + np.arange(at[-1])
    return mix(acc[first]), at


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
