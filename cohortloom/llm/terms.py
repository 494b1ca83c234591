"""Search terms of Arrow text columns as 64-bit hashes: runs of ASCII letters, digits and everything beyond ASCII, A-Z taken as a-z."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from cohortloom.llm.words import _B, mixed, powers, text_bytes

SEGMENT_BYTES = 1 << 20
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    inside = np.ones(256, bool)
    for first, last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        inside[first : last + 1] = False
    value = np.random.default_rng(0x7E12).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
    return inside, value


def terms(column: pa.Array, most: int = SEGMENT_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash and row of every term occurrence, segment by segment of ``most`` bytes, so memory does not grow with a text.

    Outside ASCII every byte of UTF-8 has its top bit set, so bytes decide as the characters would. A term that the end of a
    segment cuts is held back and completed by the next one; nulls have no terms.
    """
    data, offsets = text_bytes(column)
    inside_of, value = _tables()
    held: tuple[int, int, int] | None = None
    for a in range(0, len(data), most):
        b = min(len(data), a + most)
        here = data[a:b]
        inside = inside_of[here]
        first = np.zeros(b - a + 1, bool)
        first[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, side="right")] - a] = True
        start = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | first[:-1]))
        end = np.flatnonzero(inside & (np.r_[~inside[1:], True] | first[1:])) + 1
        up, down = powers(b - a)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[here] * up)])
        raw = (sums[end] - sums[start]) * down[start]
        size = (end - start).astype(np.uint64)
        row = np.searchsorted(offsets, start + a, side="right") - 1
        if held is not None:
            raw[0] = (held[0] + int(raw[0]) * pow(_B, held[1], 1 << 64)) & _MASK
            size[0] += np.uint64(held[1])
            held = None
        if b < len(data) and len(end) and end[-1] == b - a and not first[-1] and inside_of[data[b]]:
            held = int(raw[-1]), int(size[-1]), int(row[-1])
            raw, size, row = raw[:-1], size[:-1], row[:-1]
        yield mixed(raw + size), row
