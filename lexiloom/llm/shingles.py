"""Word shingles as 64-bit hashes, vectorised over one text."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WORDS = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between the ASCII white space characters."""
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(found: list[bytes], n: int = WORDS) -> np.ndarray:
    """Every n-word shingle's hash in order; fewer words are one shingle as a whole; no words, none."""
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < n:
        return np.array([xxh3_64_intdigest(b" ".join(found), len(found))], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out + h[k : k + len(out)] * _ODD[k % 5])
    return out


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(words(text), n))
