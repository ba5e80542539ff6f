"""Runs of text between white space: their bounds, and a table of what is known of each.

A vocabulary that splits at white space before anything else gives a text the ids of its
runs, one after the other.  The runs of many texts are hashed together (96 bits), looked up
in a table in arrays, and their ids laid out by one gather, so no step loops over words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from .hashing import Hasher, bounds

KNOWN_RUNS = 3 << 17
TOGETHER_CHARS = 1 << 19

#: White space of the vocabulary that is not ASCII's.
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: What str.split() takes for white space and the vocabulary does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_LETTER, _CLOSING = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_CLOSING[[ord(","), ord(".")]] = True


def normal_form(text: str) -> str | None:
    """The normalised text where normalising it again would change nothing, else None.

    Special tokens are found before any normalising, so texts that may hold one have none.
    """
    if "<|" in text:
        return None
    plain = (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()
    return plain if plain.isascii() or unicodedata.is_normalized("NFC", plain) else None


def closing_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of runs; a comma or full stop between a letter and white space is its own run."""
    starts, ends = bounds(raw)
    last = ends - 1
    apart = last[(last > starts) & _CLOSING[raw[last]] & _LETTER[raw[np.maximum(last - 1, 0)]]]
    return np.sort(np.concatenate((starts, apart))), np.sort(np.concatenate((ends, apart)))


class KnownRuns:
    """A hash table in arrays from the 96-bit hashes of runs to where their ids stand.

    Slots are probed one after the other, all keys of a call together.
    """

    def __init__(self, most: int):
        self.most, self.bits = most, max(4, (most + most // 3).bit_length())
        n = 1 << self.bits
        self.first, self.second = np.zeros(n, np.uint64), np.zeros(n, np.uint32)
        self.begin, self.count = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.clear()

    def clear(self) -> None:
        self.first[:] = 0
        self.used, self.ids = 0, np.empty(0, np.uint32)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is not known."""
        slots = np.full(len(first), -1, np.int64)
        at, left = (first >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(first))
        while len(left):
            here = self.first[at]
            same = (here == first[left]) & (self.second[at] == second[left])
            slots[left[same]] = at[same]
            on = ~same & (here != 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return slots

    def add(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Keys that are not known yet, each once, with the number of their ids and all of these."""
        begin = np.cumsum(count) - count + len(self.ids)
        self.ids = np.concatenate((self.ids, ids))
        self.used += len(first)
        at, left = (first >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(first))
        while len(left):
            free = np.flatnonzero(self.first[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            own = free[one]
            who, slot = left[own], at[own]
            self.first[slot], self.second[slot], self.begin[slot], self.count[slot] = first[who], second[who], begin[who], count[who]
            on = np.ones(len(left), bool)
            on[own] = False
            left, at = left[on], at[on]
            taken = self.first[at] != 0
            at = np.where(taken, at + 1, at) & ((1 << self.bits) - 1)


class RunTable:
    """Ids of whole texts; ``learn`` gives those of new runs, ``alone`` those of other texts.

    The table is bounded: when it is full it starts again from the runs of the texts at hand.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], alone: Callable[[str], np.ndarray], known_runs: int = KNOWN_RUNS):
        self.learn, self.alone = learn, alone
        self.known, self.hashers = KnownRuns(known_runs), (Hasher(), Hasher(0x9E3779B97F4A7C15))

    def together(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of some normalised texts."""
        raw = np.frombuffer(b" ".join(texts), np.uint8)
        starts, ends = closing_bounds(raw)
        first, second = (h.runs(raw, starts, ends) for h in self.hashers)
        second = second.astype(np.uint32)
        first |= np.uint64(1)  # zero marks a free slot
        slot = self.known.find(first, second)
        if (slot < 0).any() and self.known.used + int((slot < 0).sum()) > self.known.most:
            self.known.clear()
            slot[:] = -1
            if len(slot) > self.known.most:  # room for these alone
                self.known = KnownRuns(len(slot))
        cut = raw.tobytes()
        while (slot < 0).any():  # again only where two new runs agree in the first hash
            at = np.flatnonzero(slot < 0)
            new = at[np.unique(first[at], return_index=True)[1]]
            runs = [cut[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            self.known.add(first[new], second[new], *self.learn(runs))
            slot[at] = self.known.find(first[at], second[at])
        count = self.known.count[slot].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.known.ids[np.repeat(self.known.begin[slot] - total[:-1], count) + np.arange(total[-1])]
        edges = total[np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))]
        return np.split(ids, edges[:-1])

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text.  Texts whose normal form is not stable go as they stand."""
        held: list[tuple[str, bytes | None]] = []
        size = 0
        for text in texts:
            plain = normal_form(text)
            simple = plain is not None and not _SEPARATORS.search(plain)
            held.append((text, (plain if plain.isascii() else _WIDE_SPACE.sub(" ", plain)).encode() if simple else None))
            size += len(text)
            if size > TOGETHER_CHARS:
                yield from self._held(held)
                held, size = [], 0
        yield from self._held(held)

    def _held(self, held: list[tuple[str, bytes | None]]) -> Iterator[np.ndarray]:
        simple = [raw for _, raw in held if raw is not None]
        found = iter(self.together(simple) if simple else ())
        for text, raw in held:
            yield self.alone(text) if raw is None else next(found)
