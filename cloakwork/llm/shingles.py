"""Vectorised word shingles: 64-bit hashes of every k-word run of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

U = np.uint64
K1, K2, K3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
#: Bytes of text hashed at a time, so that a worker's memory does not follow the batch.
SLICE_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of x over all 64 (a finaliser; it is one to one)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of texts of about SLICE_BYTES; one very long text is a run of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > SLICE_BYTES:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are runs without ASCII white space, A-Z lower-cased.  A text of fewer
    than k words is one shingle; one without words, or null, has none.
    """
    words: list[bytes] = []
    lens = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            w = t.encode("utf-8", "surrogatepass").lower().split()
            lens[i] = len(w)
            words.extend(w)
    if not words:
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    hashed = pd.util.hash_array(np.array(words, dtype=object), categorize=True)
    with np.errstate(over="ignore"):
        n = len(hashed)
        acc = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
        for j in range(k):
            acc = (acc ^ (acc >> U(29))) * K1 + hashed[j : n - k + 1 + j] * K2
        acc = mix(acc)
        ends = np.cumsum(lens)
        out = []
        for i, c in enumerate(lens):
            lo = ends[i] - c
            if c >= k:
                out.append(np.unique(acc[lo : ends[i] - k + 1]))
            elif c == 0:
                out.append(np.zeros(0, dtype=np.uint64))
            else:
                x = np.array([c], dtype=np.uint64) * K3
                for h in hashed[lo : ends[i]]:
                    x = (x ^ (x >> U(29))) * K1 + h * K2
                out.append(mix(x))
    return out
