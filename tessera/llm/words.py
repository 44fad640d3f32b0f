"""Vectorised words: places and 64-bit hashes of all words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_RANDOM = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _MULTIPLIER), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of texts that lie end to end in ``data``; ``bounds`` has each text's first byte and the end."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        space = _IS_SPACE[data]
        start = ~space
        start[1:] &= space[:-1]
        edges = bounds[(bounds < len(data))]
        start[edges] = ~space[edges]
        end = ~space
        end[:-1] &= space[1:]
        last = bounds[bounds > 0] - 1
        end[last] = ~space[last]
        self.data, self.bounds = data, bounds
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        #: of each text, its first word; and one more for the end
        self.first = np.searchsorted(self.starts, bounds)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Of each word, its text's number."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self, classes: np.ndarray | None = None) -> np.ndarray:
        """Of each word a 64-bit hash of its bytes, or of what ``classes`` (256 bytes) makes of them."""
        return self.hashes_of(self.starts, self.ends, classes)

    def hashes_of(self, starts: np.ndarray, ends: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
        """The same of any runs of bytes."""
        table = _RANDOM if classes is None else _RANDOM[classes]
        up, down = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(table[self.data] * up[: len(self.data)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * down[starts])

    def per_text(self, marked: np.ndarray) -> np.ndarray:
        """Of each text how many of its bytes are marked."""
        return np.diff(np.concatenate(([0], np.cumsum(marked)))[self.bounds])

    def words_per_text(self, marked: np.ndarray) -> np.ndarray:
        """Of each text how many of its words are marked."""
        return np.diff(np.concatenate(([0], np.cumsum(marked)))[self.first])


def text_chunks(column: pa.Array, chunk_bytes: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, bounds) of runs of texts of about ``chunk_bytes``; a null text is empty."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk_bytes, side="right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
