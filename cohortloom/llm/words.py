"""Words and shingles of Arrow text columns as 64-bit hashes, computed on the column's bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_B = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after the other, and where each text starts (one entry more than rows)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    value = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
    for c in range(ord("A"), ord("Z") + 1):
        value[c] = value[c + 32]
    return space, value


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i below n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_B, -1, 1 << 64)
        for name, base in (("up", _B), ("down", inverse)):
            steps = np.full(size, _U(base))
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit values over all others."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, owning row, first byte and end byte of every word, A-Z taken as a-z; words are runs without ASCII white space."""
    data, offsets = text_bytes(column)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none.astype(_U), none, none, none
    space, value = _tables()
    inside = ~space[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = inside & np.r_[True, ~inside[:-1]] | inside & first[:n]
    ends = inside & np.r_[~inside[1:], True] | inside & first[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(value[data] * up)])
    h = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))
    return h, np.searchsorted(offsets, start, side="right") - 1, start, end


def shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of ``width`` words of every row: row, hash (sorted by both), and each row's number of words.

    A row with fewer words has its whole sequence as its one shingle, a row without words none.
    """
    h, row, _, _ = word_hashes(column)
    rows = len(column)
    n = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(n)])
    m, whole = _U(0xD6E8FEB86659FD93), max(0, len(h) - width + 1)
    x = h[:whole].copy()
    for k in range(1, width):
        x = x * m + h[k : whole + k]
    same = row[:whole] == row[width - 1 :] if whole else np.zeros(0, bool)
    hashes, owners = [mixed(x[same])], [row[:whole][same]]
    for size in range(1, width):
        short = np.flatnonzero(n == size)
        if len(short):
            y = h[first[short]].copy()
            for k in range(1, size):
                y = y * m + h[first[short] + k]
            hashes.append(mixed(y ^ _U(size)))
            owners.append(short)
    x, row = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return row[new], x[new], n
