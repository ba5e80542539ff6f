"""Hashes of all runs of bytes between white space, in numpy."""

from __future__ import annotations

import numpy as np

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of runs from running sums of byte times power of an odd number, modulo 2^64."""

    def __init__(self, odd: int = 0xD6E8FEB86659FD93):
        self.odd = odd
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) <= n:
            steps = np.ones(n + n // 8 + 1, np.uint64)
            steps[1:] = self.odd
            self.powers = np.cumprod(steps)
            steps[1:] = pow(self.odd, -1, 1 << 64)
            self.inverse = np.cumprod(steps)

    def runs(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash per run; A-Z count as a-z."""
        self._reach(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of each run of bytes that are no white space."""
        starts, ends = bounds(raw)
        return self.runs(raw, starts, ends), starts


def bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of bytes that are no white space."""
    solid = np.concatenate(([False], ~_WHITE[raw], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]
