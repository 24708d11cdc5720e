"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from tessel.llm.common import mix, words_of

K = 5
_FACTORS = mix(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each run of k words, given the words' hashes; a shorter text is one run of all its words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        out += words[j : len(words) - n + 1 + j] * _FACTORS[j]
    return mix(out)


def shingle_sets(texts: list[str], k: int = K) -> list[np.ndarray]:
    """The distinct shingles of each text, in ascending order."""
    w = words_of(texts)
    stops = np.cumsum(w.counts)
    if not len(w.hashes):
        return [np.zeros(0, np.uint64)] * len(texts)
    runs = shingle_hashes(w.hashes, k)
    out = []
    for b, n in zip(stops.tolist(), w.counts.tolist(), strict=True):
        out.append(np.unique(runs[b - n : b - k + 1] if n >= k else shingle_hashes(w.hashes[b - n : b], k)))
    return out


def set_key(s: np.ndarray) -> int:
    """A 64-bit digest of a sorted set; equal sets have equal digests."""
    place = np.arange(1, len(s) + 1, dtype=np.uint64)
    return int(mix(np.array([np.bitwise_xor.reduce(mix(s * np.uint64(3) + place)) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])
