"""Words and shingles of whole texts, hashed in bulk.

Words are maximal runs of anything but space and the characters 9 to 13, after lower-casing A-Z only; this is how
``bytes.lower`` and ``bytes.split`` work on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pandas.util import hash_array

SHINGLE = 5
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers."""
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes_of(words: list[bytes]) -> np.ndarray:
    """64-bit hashes that don't depend on the process."""
    if not words:
        return np.zeros(0, np.uint64)
    flat = np.empty(len(words), object)
    flat[:] = words
    return hash_array(flat, categorize=False)


def shingle_sets(texts: list[str | None], size: int = SHINGLE, chars: int = 500_000) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; fewer words than ``size`` are one shingle, none are none."""
    pending: list[list[bytes]] = []
    held = 0
    for at, text in enumerate(texts, 1):
        pending.append(words_of(text))
        held += len(text or "")
        if held < chars and at < len(texts):
            continue
        flat = hashes_of([w for words in pending for w in words])
        stops = np.cumsum([len(words) for words in pending]).tolist()
        rolled = np.zeros(max(0, len(flat) - size + 1), np.uint64)
        for k in range(size):
            rolled += flat[k : k + len(rolled)] * _FACTORS[k]
        rolled = mix(rolled)
        start = 0
        for stop in stops:
            if stop - start >= size:
                yield np.unique(rolled[start : stop - size + 1])
            elif stop > start:
                few = flat[start:stop] * _FACTORS[: stop - start]
                yield mix(np.array([few.sum(dtype=np.uint64) ^ np.uint64(stop - start)], np.uint64), 1)
            else:
                yield np.zeros(0, np.uint64)
            start = stop
        pending, held = [], 0
