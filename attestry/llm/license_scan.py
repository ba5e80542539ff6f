"""Licence notices in texts, by a generalised suffix automaton of licence words.

The automaton is built of all templates at once; its states stand for the stretches of words
that occur in them.  A text streams through it word by word, which gives the matching
statistics: at each word, the length of the longest stretch ending there that any template
holds.  A stretch that no following word makes longer is a match.  Matches of ``LEAST_MATCH``
words or more are laid on every place where their template holds them, and chained: within
one template a chain goes on in text and template, with at most ``GAP`` words of the text
between two matches.  A chain that covers ``LEAST_COVER`` of its template's words is a span
and gives the template's label.  Short phrases are templates that must stand whole.

Only words that some template holds are fed; any other word sets the automaton back, as it
ends every stretch.  Runs of known words shorter than the shortest phrase and ``LEAST_MATCH``
can't hold a match and are passed over.

The automaton is sent to every task: its size is bounded by ``TEMPLATE_WORDS`` words of
templates, and more raise an error.

Defined cases: a null text, or one without words, has no places, no spans and score 0; a very
long text is read whole; repeated rows and null ids each give a row; of chains of one template
that share words of the text the one that covers more stays, of equals the first; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tidy, to_batch

LEAST_MATCH, GAP, LEAST_COVER = 3, 6, 0.75
TEMPLATE_WORDS = 1 << 20

#: Phrases that give a label wherever they stand.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Usual wordings of notices, each with its label.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """you may not use this file except in compliance with the License. You may obtain a copy of the License at
      http://www.apache.org/licenses/LICENSE-2.0"""),
    ("apache-2.0", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
      "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("mit", "Released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
      files (the "Software"), to deal in the Software without restriction"""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
      conditions are met"""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
      as published by the Free Software Foundation"""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to the public domain"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: What each byte of a text in UTF-8 reads as: digits, letters of ASCII in lower case and all
#: bytes outside ASCII are parts of words, others part them.
_READ = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c > 127 else 32 for c in range(256))

SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int64()), ("cover", pa.float64())])
PLACE = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(PLACE)), ("spans", pa.list_(SPAN)), ("score", pa.float64())])
FOUND_DDL = "doc_id long, n_words long, places array<struct<label: string, first: long, last: long>>, spans array<struct<label: string, first: long, last: long, covered: long, cover: double>>, score double"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_READ).split()


@dataclass
class Automaton:
    """A generalised suffix automaton; state 0 is the empty stretch.

    Per state: ``step`` to the next state by word, ``link`` to the longest shorter stretch
    with other occurrences, ``length`` of its longest stretch, and ``ends``, the (text, end)
    of every occurrence.
    """

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    @classmethod
    def of(cls, texts: list[list[int]]) -> Automaton:
        made, own = cls(), []
        for text in texts:
            state, path = 0, []
            for word in text:
                state = made._extended(state, word)
                path.append(state)
            own.append(path)
        for k, path in enumerate(own):
            for end, state in enumerate(path):
                made.ends[state].append((k, end))
        for state in sorted(range(1, len(made.link)), key=made.length.__getitem__, reverse=True):
            made.ends[made.link[state]] += made.ends[state]  # a stretch ends wherever a longer one does
        made.ends = [sorted(set(ends)) for ends in made.ends]
        made.ends[0] = []
        return made

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        self.ends.append([])
        return len(self.length) - 1

    def _parted(self, state: int, word: int, to: int) -> int:
        """The state of the stretch of ``state`` and ``word``, split from the longer ones of ``to`` where need be."""
        if self.length[to] == self.length[state] + 1:
            return to
        part = self._state(self.length[state] + 1, self.link[to], dict(self.step[to]))
        self.link[to] = part
        while state >= 0 and self.step[state].get(word) == to:
            self.step[state][word] = part
            state = self.link[state]
        return part

    def _extended(self, last: int, word: int) -> int:
        if word in self.step[last]:  # another text holds this stretch already
            return self._parted(last, word, self.step[last][word])
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._parted(last, word, self.step[last][word])
        return new

    def statistics(self, text: list[int]) -> list[tuple[int, int]]:
        """At each word the state and length of the longest stretch that ends there."""
        state = held = 0
        out = []
        for word in text:
            while state and word not in self.step[state]:
                state = self.link[state]
                held = self.length[state]
            following = self.step[state].get(word)
            state, held = (0, 0) if following is None else (following, held + 1)
            out.append((state, held))
        return out


class Scanner:
    """Phrases and notices as one automaton, and the search of texts for them."""

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.ids: dict[bytes, int] = {}
        texts = [words_of(text) for _, text in (*phrases, *notices)]
        if sum(map(len, texts)) > TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {TEMPLATE_WORDS} words")
        self.labels = [label for label, _ in (*phrases, *notices)]
        self.sizes = [len(text) for text in texts]
        self.automaton = Automaton.of([[self.ids.setdefault(w, len(self.ids)) for w in text] for text in texts])
        self.notices = range(len(phrases), len(texts))
        self.shortest = min([LEAST_MATCH, *self.sizes[: len(phrases)]])
        # (words, phrase) of the phrases that the stretches of a state, or the shorter ones on its links, end with
        made = self.automaton
        self.whole: list[list[tuple[int, int]]] = [[] for _ in made.ends]
        for state in sorted(range(1, len(made.ends)), key=made.length.__getitem__):
            sizes = range(made.length[made.link[state]] + 1, made.length[state] + 1)
            own = [(self.sizes[k], k) for k, end in made.ends[state] if k < len(phrases) and end == self.sizes[k] - 1 and self.sizes[k] in sizes]
            self.whole[state] = own + self.whole[made.link[state]]

    def known_runs(self, words: list[bytes]) -> list[tuple[int, list[int]]]:
        """(first, ids) of each run of known words that is long enough to hold a match."""
        ids = np.fromiter((self.ids.get(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([-1], ids, [-1])) >= 0))
        return [(low, ids[low:high].tolist()) for low, high in edges.reshape(-1, 2).tolist() if high - low >= self.shortest]

    def scanned(self, words: list[bytes]) -> tuple[list[tuple], list[tuple], float]:
        """(label, first word, last word) of whole phrases, the spans of notices, and the score."""
        places, matches = [], []
        for low, ids in self.known_runs(words):
            found = self.automaton.statistics(ids)
            for at, (state, held) in enumerate(found):
                for size, k in self.whole[state]:
                    if held >= size:
                        places.append((self.labels[k], low + at - size + 1, low + at))
                if held >= LEAST_MATCH and (at + 1 == len(found) or found[at + 1][1] <= held):
                    matches.append((low + at - held + 1, held, state))
        chains = self.chained(matches)
        score = max((c[3] / self.sizes[k] for k, some in chains.items() for c in some), default=0.0)
        return sorted(places, key=lambda p: p[1:]), self.spans_of(chains), 1.0 if places else score

    def chained(self, matches: list[tuple[int, int, int]]) -> dict[int, list[list[int]]]:
        """Chains of the matches (first, words, state), by notice: [first, last, last in the notice, covered]."""
        chains: dict[int, list[list[int]]] = {}
        near: dict[int, list[list[int]]] = {}  # the chains that can still go on
        for first, size, state in matches:
            last = first + size - 1
            for k, end in self.automaton.ends[state]:
                if k not in self.notices:
                    continue
                at = end - size + 1
                near[k] = [c for c in near.get(k, ()) if first - c[1] <= GAP + 1]
                shared = lambda c: max(0, c[1] - first + 1, c[2] - at + 1)  # noqa: B023, E731
                best = max((c for c in near[k] if c[1] < last and c[2] < end), key=lambda c: c[3] - shared(c), default=None)  # noqa: B023
                if best is None:
                    chain = [first, last, end, size]
                    chains.setdefault(k, []).append(chain)
                    near[k].append(chain)
                else:
                    best[1:] = [last, end, best[3] + size - shared(best)]
        return chains

    def spans_of(self, chains: dict[int, list[list[int]]]) -> list[tuple[str, int, int, int, float]]:
        """The chains that cover enough of their notice; those of one notice share no words."""
        spans = []
        for k, some in chains.items():
            kept: list[tuple[int, int, int]] = []
            for first, last, _, covered in sorted((c for c in some if c[3] >= LEAST_COVER * self.sizes[k]), key=lambda c: (-c[3], c[0])):
                at = bisect_left(kept, (first, last, covered))
                if (at == 0 or kept[at - 1][1] < first) and (at == len(kept) or kept[at][0] > last):
                    insort(kept, (first, last, covered))
            spans += [(self.labels[k], first, last, covered, covered / self.sizes[k]) for first, last, covered in kept]
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))


def scans(documents: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, the places of phrases, the spans of notices, and the largest share of a template that the text holds."""
    scanner = Scanner(phrases, notices)

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0), text_or_empty(batch), strict=True):
                words = words_of(text)
                places, spans, score = scanner.scanned(words)
                rows.append((
                    doc_id.as_py(), len(words), [dict(zip(("label", "first", "last"), p, strict=True)) for p in places],
                    [dict(zip(("label", "first", "last", "covered", "cover"), s, strict=True)) for s in spans], score,
                ))
                held += 1 + len(places) + len(spans)
                if held >= 4096:
                    yield to_batch(FOUND, zip(*rows, strict=True))
                    rows, held = [], 0
            if rows:
                yield to_batch(FOUND, zip(*rows, strict=True))

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(tidy(run), FOUND_DDL)


def digests(found: DataFrame) -> DataFrame:
    """One row per text: the phrases' places counted, their smallest and largest first word, the labels of phrases and of all, the score."""
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    both = F.array_sort(F.array_union(F.transform("places", lambda p: p["label"]), F.transform("spans", lambda s: s["label"])))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(F.transform("places", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["first"])).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), "score",
    )
