"""Hashed word shingles of a text."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words, repeats included; of the whole sequence if there are fewer; none without words."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(own) <= words:
        return np.array([xxh64_intdigest(b" ".join(own), SEED)] if own else [], np.uint64)
    joined = b" ".join(own)
    size = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    return np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[: len(own) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)
