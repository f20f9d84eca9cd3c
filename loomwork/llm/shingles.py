"""Hashes of word shingles."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash

SEED = 42


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of all word shingles of UTF-8 bytes, A-Z lower-cased; words stand between ASCII white space."""
    found = text.lower().split()  # of bytes: ASCII rules only
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    joined = b" ".join(found)
    sizes = list(map(len, found))
    starts = [0, *accumulate(n + 1 for n in sizes[:-1])]
    ends = [s + n for s, n in zip(starts[words - 1 :], sizes[words - 1 :])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], np.uint64)
