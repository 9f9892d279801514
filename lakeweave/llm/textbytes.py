"""Words, shingles and lines of many texts at once, as numpy arrays over their UTF-8 bytes.

Arrow hands a task its texts as one run of bytes with offsets. Everything here works on such
a run: no Python object is made for a word. Words are runs without the bytes 0x20 and
0x09-0x0D. Equality of words, shingles and lines is equality of their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# A slice of texts holds about this many bytes; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_RNG = np.random.default_rng(20_240_601)
_ODD = lambda n: _RNG.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _ODD(256)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; one to one."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, made once per process."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(n + 1, SLICE_BYTES + 4096)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


class Texts:
    """Some texts: ``buf`` their bytes, text ``i`` from ``offsets[i]`` to ``offsets[i + 1]``."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool) -> None:
        self.raw, self.offsets, self.size = buf, offsets, len(offsets) - 1
        self.buf = LOWER[buf] if lower else buf
        n = len(buf)
        space = SPACE[buf]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begins = ~space
        begins[1:] &= space[:-1] | first[1:n]
        ends = ~space
        ends[:-1] &= space[1:] | first[1:n]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        # Words of text i are first_word[i] to first_word[i + 1].
        self.first_word = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.first_word)

    def bytes_of(self, i: int) -> bytes:
        return self.raw[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each given run of bytes; equal runs hash alike wherever they stand."""
        up, down = _Powers.upto(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * up[: len(self.buf)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def windows(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of every run of ``k`` words within a text, its first word, and the bounds by text."""
        counts = np.maximum(self.n_words - (k - 1), 0)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(bounds[-1]) + np.repeat(self.first_word[:-1] - bounds[:-1], counts)
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h = h * _WORD_BASE + words[at + j]
        return mix(h), at, bounds

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def slices(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[tuple[int, Texts]]:
    """The texts of an Arrow column in slices, each with the row it begins at; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(column))
        low, high = int(offsets[row]), int(offsets[end])
        yield row, Texts(data[low:high], (offsets[row : end + 1] - low).astype(np.int64), lower)
        row = end
