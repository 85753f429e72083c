"""Words and their hashes, as arrays, for the operators on word sequences."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class WordHashes(dict):
    """64-bit hash of a word, kept for words seen before."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least ``count`` of each."""
    if len(_powers[0]) < count:
        size = 1 << (count - 1).bit_length()
        for index, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[index] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive elements, by differences of one weighted running sum."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.uint64)
    powers, inverses = _power_tables(len(hashes))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * powers[: len(hashes)], dtype=np.uint64)])
    count = len(hashes) - width + 1
    return mix((sums[width:] - sums[:count]) * inverses[:count])
