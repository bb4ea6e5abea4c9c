"""Word hashing over Arrow string buffers, without a Python object per word.

A word is a run of ASCII letters, digits, ``_`` and any character beyond ASCII,
after lower-casing. Texts are taken whole; only the block of texts that is
worked on at once is bounded (``BLOCK`` bytes, or one text if that is longer).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pows: dict[str, np.ndarray] = {}

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def give_back() -> None:
    """Return what this process has freed to the system; where the C library can't, nothing happens."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a task's batches; its worker waits for the next task without the memory of this one, beside others that work."""

    @wraps(run)
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _pows.get(name)
    if have is None or len(have) < n:
        grown = np.full(max(n, 2 * BLOCK), base, np.uint64)
        grown[0] = 1
        have = _pows[name] = np.multiply.accumulate(grown)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """Words of a block of texts. ``at[i]:at[i+1]`` are the words of text i."""

    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    data: np.ndarray
    sums: np.ndarray

    def prefix(self, k: int) -> np.ndarray:
        """Hashes of the first k bytes of each word (of all of it, if shorter)."""
        end = np.minimum(self.end, self.start + k)
        return mix((self.sums[end] - self.sums[self.start]) * _powers("q", _PINV, len(self.sums))[self.start])


def strings(column: pa.Array) -> pa.Array:
    """A null-free string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n+1) and bytes of a string array, both as views."""
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1] if off is not None and len(column) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, raw


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of about ``limit`` bytes each; a longer text comes alone."""
    column = strings(column)
    offsets, _ = buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, column.slice(i, j - i)
        i = j


def words(texts: pa.Array, lower: bool = True) -> Words:
    """Hash every word of the texts (a null-free string array)."""
    if lower:
        texts = pc.utf8_lower(texts)
    offsets, raw = buffers(texts)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data, edge = raw[lo:hi], (offsets - lo).astype(np.int64)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z.astype(np.uint64), z, z, np.zeros(len(edge), np.int64), data, np.zeros(1, np.uint64))
    inside = np.zeros(n + 1, bool)
    inside[:n] = IS_WORD[data]
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    last = inside[:n] & ~inside[1:]
    cut = edge[(edge > 0) & (edge < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("p", _P, n), out=sums[1:])
    h = mix((sums[end] - sums[start]) * _powers("q", _PINV, n)[start])
    return Words(h, start, end, np.searchsorted(start, edge), data, sums)


def grams(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and their boundaries by text.

    A text of fewer than k words (but one at least) has one gram of all of them.
    """
    n, rows = len(h), len(at) - 1
    size = np.diff(at)
    acc = np.zeros(n, np.uint64)
    mult = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            mult = mult * np.uint64(0xD6E8FEB86659FD93) if j else np.uint64(0xA24BAED4963EE407)
            acc[: n - j] += h[j:] * mult
    row = np.repeat(np.arange(rows), size)
    pos = np.arange(n) - at[:-1][row]
    keep = pos + k <= size[row]
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        for r in short:
            a, mult, s = at[r], np.uint64(1), np.uint64(0)
            with np.errstate(over="ignore"):
                for j in range(size[r]):
                    mult = mult * np.uint64(0xD6E8FEB86659FD93) if j else np.uint64(0xA24BAED4963EE407)
                    s += h[a + j] * mult
            acc[a], keep[a] = s, True
    per = np.where(size >= k, size - k + 1, (size > 0).astype(size.dtype))
    return mix(acc[keep]), np.concatenate([[0], np.cumsum(per)])
