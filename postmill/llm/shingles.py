"""Words and word shingles of whole texts as 64-bit hashes, for code inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

# Words whose hashes a worker keeps, and the longest of them, in bytes; a full store starts anew,
# so words that come once do not crowd out those that come often. Some 15 MB at most.
KEPT_WORDS, KEPT_WORD = 100_000, 40
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT_WORD:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value


_HASHES = WordHashes()


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split() if text else []


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit numbers that spreads close values apart."""
    values = (values ^ values >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `width` words; a text with fewer words is
    one shingle, a text without words has none."""
    own = hashes_of(words_of(text))
    if not len(own):
        return own
    used = min(width, len(own))
    total = np.full(len(own) - used + 1, used, np.uint64)
    for i in range(used):
        total = mix(total * _STEP + own[i : len(own) - used + 1 + i])
    return np.unique(total)
