"""Whole-batch text work in numpy on the buffers of Arrow string arrays.

Words are runs of bytes other than 0x20 and 0x09-0x0D; all separators are
ASCII, so UTF-8 needs no decoding. Hashes are 64-bit: polynomials over random
byte values, modulo 2**64, then mixed. Work goes in slices of about a megabyte
of text (at least one document), so memory follows the longest document and
not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = (np.ones(1, U), np.ones(1, U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, x, U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        if size > 1 << 22:
            return both[0], both[1]  # of a very long text only; not kept
        _powers = (both[0], both[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


class Slice:
    """Some documents of a batch: ``data`` bytes and ``off`` (one more than documents)."""

    def __init__(self, first: int, data: np.ndarray, off: np.ndarray):
        self.first, self.data, self.off = first, data, off
        self.n = len(off) - 1

    def words(self, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and where each document's words begin (one more than documents)."""
        data, off = self.data, self.off
        sep = separator[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[off] = True
        begins = begins[:-1]
        start = ~sep
        start[1:] &= sep[:-1] | begins[1:]
        end = np.zeros(len(data) + 1, bool)
        end[1:-1] = ~sep[:-1] & (sep[1:] | begins[1:])
        if len(data):
            end[-1] = not sep[-1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end)
        return starts, ends, np.searchsorted(starts, off)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of byte spans."""
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U)
        np.cumsum((LOWER_VALUE if lower else BYTE_VALUE)[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def slices(text: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The documents of a string array in order; null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    if not len(text):
        return
    wide = pa.types.is_large_string(text.type)
    bufs = text.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield Slice(a, data[off[a] : off[b]], off[a : b + 1] - off[a])
        a = b


def per_doc(values: np.ndarray, bounds: np.ndarray, kind: np.ufunc = np.add, empty=0) -> np.ndarray:
    """Reduce a flat array over the documents' ranges; ``empty`` where a range is empty."""
    n = len(bounds) - 1
    out = np.full(n, empty, values.dtype)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = kind.reduceat(values, bounds[some])[: len(some)] if bounds[some[-1] + 1] == len(values) else kind.reduceat(values[: bounds[some[-1] + 1]], bounds[some])
    return out


def owners(bounds: np.ndarray) -> np.ndarray:
    """The document of each element."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


_WORD_MULT = _rng.integers(1, 2**63, 16, dtype=U) * U(2) + U(1)


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` words in a row, and their bounds by document.

    A document with fewer words, but some, has its whole sequence as one shingle.
    """
    count = np.diff(bounds)
    made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    first = np.repeat(bounds[:-1], made) + (np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], made))
    length = np.repeat(np.minimum(count, k), made)
    out = length.astype(U) * U(0xA24BAED4963EE407)
    for j in range(k):
        here = length > j
        if here.all():
            out += words[first + j] * _WORD_MULT[j]
        else:
            out[here] += words[first[here] + j] * _WORD_MULT[j]
    return mix(out), out_bounds
