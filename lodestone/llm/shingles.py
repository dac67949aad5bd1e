"""Word shingles of many documents at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lodestone.llm.arrow import flat_bytes
from lodestone.llm.chunking import BASE, MIX

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
JOIN = np.uint64(0xD6E8FEB86659FD93)


def _mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values = values * JOIN
    return values ^ (values >> np.uint64(29))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, A-Z in lower case, and where the words of each text begin and end."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~space
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begins = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], space[:-1]])))
    stops = np.flatnonzero(word & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1
    cut = np.searchsorted(begins, bounds)
    if not len(begins):
        return np.zeros(0, np.uint64), cut
    sizes = stops - begins
    powers = np.multiply.accumulate(np.full(int(sizes.max()), BASE, np.uint64))
    own = data[word]
    first = np.cumsum(sizes) - sizes
    terms = MIX[LOWER[own]] * powers[np.arange(len(own)) - np.repeat(first, sizes)]
    return _mix(np.add.reduceat(terms, first) + sizes.astype(np.uint64)), cut


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For every text the sorted distinct hashes of its shingles of ``size`` words.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    words, cut = word_hashes(*flat_bytes(column))
    count = max(len(words) - size + 1, 0)
    joined = np.full(count, size, np.uint64)
    for k in range(size):
        joined = _mix(joined * JOIN + words[k : k + count])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= size:
            yield np.unique(joined[a : b - size + 1]).view(np.int64)
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                whole = _mix(whole * JOIN + words[k : k + 1])
            yield whole.view(np.int64)
        else:
            yield np.zeros(0, np.int64)
