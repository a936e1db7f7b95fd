"""Word sequences as 64-bit hashes, for the operators on word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers, one for each place of a word in a shingle: sums of products in 64 bits.
_GAMMA = 0x9E3779B97F4A7C15
_PLACE = [np.uint64((_GAMMA * (2 * i + 3) | 1) & (1 << 64) - 1) for i in range(64)]

#: A word of the plain kind is a run of ASCII letters, digits and non-ASCII characters: of bytes
#: in UTF-8 it is a run of those kept here; the others become spaces.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, ASCII digits and all non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


def spaced_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but space and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """word -> place in ``table``, which holds xxh64 of the word.  Cleared when over ``limit`` words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit
        self.table = np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros(i, np.uint64)])
        self.table[i] = xxhash.xxh64_intdigest(word)
        self[word] = i
        return i

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.table[at]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads sums of products over all 64 bits (a one-to-one map)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, in order of place; empty if there are fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size * 0x51ED27 + 1))
    for i in range(size):
        out += hashes[i : i + n] * _PLACE[i]
    return mix(out)


def shingle_set(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct shingles; a shorter sequence counts as one shingle of its own length."""
    n = len(hashes)
    return np.unique(shingles(hashes, size if n >= size else n)) if n else np.zeros(0, np.uint64)
