"""Numpy kernels over the text buffers of Arrow batches.

Texts are handled as UTF-8 bytes in pieces of bounded size; both word classes
are defined on ASCII, so every byte of a longer character is a word byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4 << 20
_STEP = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _class(separators: list[int]) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[separators] = 0
    return table


#: Byte to lower-case byte, 0 for separators: `[^\x20\x09-\x0D]+` lower-cased.
SPACED = _class([0x20, *range(0x09, 0x0E)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = _class([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _byte_keys() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P)) | np.uint64(1)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64; kept while they are short."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1024), base, np.uint64)
        full[0] = 1
        have = np.cumprod(full, dtype=np.uint64)
        if n <= 2 * _STEP:
            _powers[base] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, len(column) + 1 + column.offset)[column.offset :]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: (first row, end row, bytes, offsets)."""
    data, off = buffers(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row: (mapped bytes, starts, ends, first word of each row and the total)."""
    low = table[data]
    n = len(low)
    if not n:
        e = np.zeros(0, np.int64)
        return low, e, e, np.zeros(len(off), np.int64)
    inside = low != 0
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = before
    after[-1] = False
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, off)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: differences of prefix sums of a polynomial, mixed."""
    out = np.empty(len(starts), np.uint64)
    keys, inverse = _byte_keys(), pow(_P, -1, 1 << 64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _STEP)))
        a, n = int(starts[i]), int(ends[j - 1] - starts[i])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(keys[low[a : a + n]] * _power(_P, n), out=sums[1:])
        s = starts[i:j] - a
        out[i:j] = (sums[ends[i:j] - a] - sums[s]) * _power(inverse, n)[s]
        i = j
    return mix64(out)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive items (rows aren't told apart here)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m]
    return mix64(out)


def text_word_hashes(text: str, table: np.ndarray = ALNUM) -> np.ndarray:
    """Hashes of one text's words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    low, s, e, _ = words(data, np.array([0, len(data)]), table)
    return word_hashes(low, s, e)


def spans_of(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of ranges first[i] .. first[i]+count[i]-1."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return base + np.arange(total)
