"""Words and hashes of whole texts as numpy arrays, a few megabytes at a time.

Texts come as Arrow string columns.  A block is a run of rows with about ``limit`` bytes (one row may be longer: texts are
never cut).  Everything below works on the bytes of a block at once, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row offsets within the block, bytes) of each block; null is an empty text."""
    texts = column.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, offsets[low:high + 1] - offsets[low], data[offsets[low]:offsets[high]]
        low = high


def spans(data: np.ndarray, rows: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes with ``member[byte]``; no run crosses a row's border."""
    inside = member[data]
    border = np.zeros(len(data) + 1, bool)
    border[rows] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    return starts, np.flatnonzero(inside & (~after | border[1:])) + 1


def rows_of(starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The row of the block in which each position lies."""
    return np.searchsorted(rows, starts, "right") - 1


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on every input bit."""
    x = values + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2 ** 64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RunHash:
    """64-bit polynomial hashes of byte runs from one running sum over the block. A-Z count as a-z."""

    def __init__(self, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.table = draw.integers(1, 2 ** 63, 256, dtype=np.uint64)
        self.table[65:91] = self.table[97:123]
        self.base = int(draw.integers(1 << 40, 1 << 62)) | 1
        self.seed = seed
        self.powers, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        back = pow(self.base, -1, 2 ** 64)
        while len(self.powers) < size:
            n = len(self.powers)
            self.powers = np.concatenate([self.powers, self.powers * np.uint64(pow(self.base, n, 2 ** 64))])
            self.inverse = np.concatenate([self.inverse, self.inverse * np.uint64(pow(back, n, 2 ** 64))])

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[:len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * _STEP, self.seed)
