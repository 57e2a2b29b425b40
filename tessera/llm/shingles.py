"""Word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_WORDS_KEPT = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hash_of = _Hashes().__getitem__


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles: A-Z lower-cased, words between the bytes 20 and 09 to 0D.
    Fewer words than a shingle are one shingle; no words, none."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(_hash_of, words), np.uint64, len(words))
    if len(words) < WORDS:
        a = np.concatenate([np.full(WORDS - len(words), len(words), np.uint64), a])
    count = len(a) - WORDS + 1
    h = a[:count] * _MULTIPLIERS[0]
    for i in range(1, WORDS):
        h = (h ^ (h >> np.uint64(31))) * _MULTIPLIERS[1] + a[i : i + count] * _MULTIPLIERS[i]
    return np.unique(mix(h))
