"""Words, word hashes and word runs of text batches, as flat numpy arrays."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a run of letters and digits.
WORD = re.compile(r"[^\W_]+")

_known: dict[str, int] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (multiply and shift)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hash(w: str) -> int:
    h = _known.get(w)
    if h is None:
        if len(_known) > 2_000_000:
            _known.clear()
        h = _known[w] = xxhash.xxh3_64_intdigest(w)
    return h


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the word hashes of all texts in a row; text i has offsets[i]:offsets[i+1]."""
    flat: list[int] = []
    offsets = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            flat.extend(map(word_hash, WORD.findall(t.lower())))
        offsets[i + 1] = len(flat)
    return np.array(flat, np.uint64), offsets


def runs(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of n words, number of the text of each)."""
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(size)), size)
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = doc[:m] == doc[n - 1 :]
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
    return out[inside], doc[:m][inside]


def distinct_runs(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, offsets): each text's distinct runs of n words, sorted, with their counts."""
    h, d = runs(*hashed_words(texts), n)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(h)))
    offsets = np.searchsorted(d[at], np.arange(len(texts) + 1))
    return h[at], counts, offsets
