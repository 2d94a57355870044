"""Words of whole texts as numpy arrays over their UTF-8 bytes.

Texts stay in Arrow's buffers. A block holds a quarter of a megabyte of them (or one longer text), so memory doesn't
grow with the batch, and each step is a few passes of numpy over bytes that stay in the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
_P, _M64 = 0x9E3779B97F4A7C55, (1 << 64) - 1
_Q = [pow(0xD1B54A32D192ED03, k + 1, 1 << 64) for k in range(64)]
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

#: Bytes to bytes with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space ends, and of words of letters, digits and what lies beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, n at least."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            x = np.full(n, np.uint64(base))
            x[0] = 1
            out.append(np.cumprod(x))
        _powers = tuple(out)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's last steps)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(texts: pa.Array, target: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offset of each row and the end) for runs of rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + target, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """The words of a block: byte positions, a 64-bit hash each, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        self.low = low = LOWER[data]
        inside = word_bytes[low]
        n = len(low)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            cut = offsets[1:-1]
            before[cut[cut < n]] = False  # a word ends with its row
            after[cut[cut > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        p, inverse = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])
        self.first = np.searchsorted(self.starts, offsets)  # of each row, and the end

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int) -> np.ndarray:
        """A hash for each run of `size` words; runs that cross rows are included, see `whole`."""
        n = max(0, len(self) - size + 1)
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out += self.hashes[k : k + n] * np.uint64(_Q[k])
        return mix(out + np.uint64(size))

    def whole(self, size: int) -> np.ndarray:
        """Which of windows(size) lie in one row."""
        n = max(0, len(self) - size + 1)
        last = np.repeat(self.first[1:], self.counts())[:n]
        return np.arange(n) + size <= last

    def text(self, a: int, b: int) -> bytes:
        """Words a to b - 1 with a blank between."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True))
