"""Words of whole Arrow text columns as 64-bit numbers, without a Python loop over words.

Texts are cut into blocks of about ``BLOCK_BYTES`` (a longer text is one block), so the
working memory does not follow the size of an Arrow batch.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_pow = np.ones(1, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but the six ASCII white-space characters.
BLACK = np.ones(256, dtype=bool)
BLACK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: ASCII letters, digits and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a sum depend on all bits of its terms."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        grown = np.full(max(n, 2 * len(_pow)), _BASE, dtype=np.uint64)
        grown[0] = 1
        _pow = np.cumprod(grown, dtype=np.uint64)
    return _pow


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of consecutive rows; offsets start at 0."""
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, dtype=kind, count=len(texts) + 1, offset=texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(off, off[row] + BLOCK_BYTES, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def words(raw: np.ndarray, off: np.ndarray, chars: np.ndarray = BLACK, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each row the index of its first word (one more at the end)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(off), dtype=np.int64)
    inside = chars[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = off[:-1][off[:-1] < n]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    at = np.searchsorted(starts, off).astype(np.int64)
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64), at
    low = (LOWER[raw] if lower else raw)[starts[0] :]
    pos = np.arange(n - starts[0], dtype=np.int64)
    pos -= np.repeat(starts - starts[0], np.diff(np.append(starts, n)))
    value = low.astype(np.uint64)
    value += _U(1)
    value *= _powers(int(pos.max()) + 1)[pos]
    value[~inside[starts[0] :]] = 0
    return mix(np.add.reduceat(value, starts - starts[0])), at


def shingles(word: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingles of ``k`` words.

    A row of fewer words has its whole sequence as one shingle, a row without words none.
    """
    n = len(word)
    if n >= k:
        every = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            every = mix(every + word[j : n - k + 1 + j])
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            one = np.zeros(1, dtype=np.uint64)
            for j in range(a, b):
                one = mix(one + word[j : j + 1])
            yield one
        else:
            yield np.zeros(0, dtype=np.uint64)
