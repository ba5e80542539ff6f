"""Hashed features of words: the word itself and its character n-grams."""

from __future__ import annotations

import numpy as np

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_EDGES = np.array([ord("<"), ord(">")], np.uint32)


def _mix(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each whole run of values: its sum of value times power, from running sums modulo 2^64."""
    steps = np.full(len(values) + 1, _FACTOR, np.uint64)
    steps[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * np.cumprod(steps)[:-1], dtype=np.uint64)))
    steps[1:] = pow(int(_FACTOR), -1, 1 << 64)
    return (sums[ends] - sums[starts]) * np.cumprod(steps)[starts]


def hashed(words: list[str], buckets: int, sizes: tuple[int, ...] = (2, 3, 4)) -> tuple[np.ndarray, np.ndarray]:
    """(features, starts): buckets of each word's n-grams, and of the whole word last.

    Word k owns ``features[starts[k]:starts[k + 1]]``, at least one of them.  All words are
    hashed together: a rolling product over one array of code points.
    """
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    marked = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(lengths + 2)
    begins = ends - lengths - 2
    owner = np.repeat(np.arange(n), lengths + 2)
    room = np.repeat(ends, lengths + 2) - np.arange(len(marked))  # code points left in the word
    owners, found = [], []
    rolled = np.zeros(len(marked), np.uint64)
    for k in range(max(sizes)):
        tail = marked[k:]
        rolled[: len(tail)] = (rolled[: len(tail)] + tail) * _FACTOR
        if k + 1 in sizes:
            at = np.flatnonzero(room >= k + 1)
            owners.append(owner[at])
            found.append(_mix(rolled[at] + np.uint64(k)))
    owners.append(np.arange(n))
    found.append(_mix(_sums(marked, begins, ends) + lengths.astype(np.uint64) * np.uint64(1 << 40)))
    owner, feature = np.concatenate(owners), np.concatenate(found) % np.uint64(buckets)
    order = np.argsort(owner, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))) if n else np.zeros(1, np.int64)
    return feature[order].astype(np.int64), starts


def means(words: list[str], weights: np.ndarray, sizes: tuple[int, ...] = (2, 3, 4)) -> np.ndarray:
    """Mean weight (a row per bucket, or a number) of each word's features."""
    feature, starts = hashed(words, len(weights), sizes)
    sums = np.add.reduceat(weights[feature], starts[:-1], axis=0) if len(words) else weights[:0]
    count = np.diff(starts).reshape(-1, *[1] * (weights.ndim - 1))
    return sums / count
