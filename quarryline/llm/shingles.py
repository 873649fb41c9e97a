"""Word shingles of texts as 64-bit hashes, in Arrow slices."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from quarryline.llm.common import words_of

#: Words of a shingle.
WIDTH = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
    hashes = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    return hashes[coded.indices.to_numpy(zero_copy_only=False)]


def shingles(text: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each text in sequence, and the texts' offsets.

    A text of fewer words has one shingle of all of them, a text without words none.
    """
    words, offsets = words_of(text)
    counts = np.diff(offsets)
    hashes = word_hashes(words)
    n = len(hashes)
    starts = offsets[:-1]
    have = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(have)])
    at = np.repeat(starts - ends[:-1], have) + np.arange(ends[-1])
    limit = np.repeat(np.minimum(counts, width), have)
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = limit > k
        more = total * _STEP + hashes[np.minimum(at + k, max(n - 1, 0))] if n else total
        total = np.where(inside, mixed(more), total)
    return total, ends


def minhashes(hashes: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """``size`` minimum hashes, of 32 bits, of each text that has shingles; the others get zeros."""
    out = np.zeros((len(offsets) - 1, size), np.uint32)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        rng = np.random.default_rng(20)
        factors = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for i, factor in enumerate(factors):
            out[some, i] = np.minimum.reduceat((hashes ^ (hashes >> np.uint64(29))) * factor, offsets[some]) >> np.uint64(32)
    return out
