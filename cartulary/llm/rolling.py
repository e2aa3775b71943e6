"""Word hashes and hashes of word windows, by numpy over whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the two polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD = 1 << 64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, WORD)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.base, m), _powers(self.inverse, m)
        return self.up[:n], self.down[:n]


_CACHE = [Powers(b) for b in BASES]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Windows:
    """Hashes of any windows of a sequence of hashes, after linear preparation."""

    def __init__(self, hashes: np.ndarray, which: int = 0) -> None:
        n = len(hashes)
        self.up, down = _CACHE[which].get(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((hashes if not which else mixed(hashes + np.uint64(which))) * down[1:], out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """The hash of length items from each of starts; equal for equal windows wherever they stand."""
        return mixed((self.sums[starts + length] - self.sums[starts]) * self.up[starts])


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n items lie in a window of length items from one of starts."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, n), -1)
    return np.cumsum(steps[:n]) > 0
