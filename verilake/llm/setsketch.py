"""Shingle sets and SuperMinHash signatures of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from verilake.llm import words as W
from verilake.llm.words import mix


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, in order; fewer words count as one run, none as no run."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return h


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    for _, data, edges in W.slices(texts):
        start, stop = W.spans(data, edges)
        h = W.hashes(data, start, stop)
        cuts = np.searchsorted(start, edges).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield np.unique(shingles(h[a:b], n))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The text's distinct shingle hashes, ascending."""
    return next(shingle_sets(pa.array([text], pa.string()), n))


def superminhash(elements: np.ndarray, m: int) -> np.ndarray:
    """The SuperMinHash signature of a set of distinct 64-bit hashes.

    Each element draws a random permutation of the m positions; in round j it
    offers j plus a random fraction at the j-th position of its permutation, and a
    position keeps the least offer. The ranks of one element are thus all
    different, which is what lowers the variance against independent minima. No
    later round offers less than its number, so the rounds stop as soon as every
    position has an offer below it: after one or two for sets larger than m log m.
    """
    signature = np.full(m, np.inf)
    if not len(elements):
        return signature
    order = None
    for j in range(m):
        r = mix(elements + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1)))
        k = (j + (r & np.uint64(0xFFFFFFFF)) % np.uint64(m - j)).astype(np.int64)
        offer = j + (r >> np.uint64(32)).astype(float) / 2.0**32
        if order is None and j == 0:
            first = k
            at = k
        else:
            if order is None:  # Fisher-Yates, with the first swap made
                order = np.tile(np.arange(m, dtype=np.int16), (len(elements), 1))
                rows = np.arange(len(elements))
                order[rows, 0], order[rows, first] = first, 0
            at = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
        np.minimum.at(signature, at, offer)
        if signature.max() < j + 1:
            break
    return signature


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of ``rows`` positions, different between bands."""
    values = signature.view(np.uint64).reshape(-1, rows)
    h = np.arange(1, len(values) + 1, dtype=np.uint64)
    for i in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + values[:, i])
    return h.view(np.int64)
