"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

Frequent words are compiled into a shared-suffix automaton whose arc outputs add up to the
word's slot in an id table.  The compiled arrays are one file that every Python worker
memory-maps.  Words that are not in the lexicon are merged exactly, by rank, so the ids
equal those of the tokenizers library for any text.

Defined cases: a null or empty text has no ids and decodes to the empty string; a very long
text, or one very long run without spaces, is merged whole in n log n steps; of pairs of equal
rank the leftmost is merged first; of equally frequent words the smaller is in the lexicon;
repeated rows each give a row; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_in_stage, partitions_for, shared_folder, text_or_empty, tidy, to_batch
from .runs import KNOWN_RUNS, RunTable, normal_form

#: Unicode white space as the vocabulary's split pattern understands it.
WHITE = "\t-\r \x85\xa0  -     　"
_WHITE_RUN = regex.compile(f"[{WHITE}]+")
#: str.split() would also cut at these four characters, which are no white space here.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
#: A comma or full stop between a letter and white space is a piece of its own.
_CLOSED = re.compile("([a-zß-öø-ÿ])([.,])(?=[ \t\n\r])")
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")

LEXICON_WORDS = 1 << 18
COUNTER_WORDS = 1 << 18


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def split_white(text: str) -> list[str]:
    """The runs of a text between white space."""
    if _SEPARATORS.search(text):
        return [run for run in _WHITE_RUN.split(text) if run]
    return text.split()


def runs_of(text: str) -> list[str]:
    """Runs whose ids, one after the other, are the ids of the text.

    Runs are normalised where normalising them again would change nothing, with the comma
    or full stop that closes a word apart, so that fewer different runs are met.  Special
    tokens are found before any normalising, so texts that may hold one keep their runs.
    """
    plain = normal_form(text)
    return split_white(text if plain is None else _CLOSED.sub(r"\1 \2", plain))


def count_pieces(run: str) -> int:
    """Words of a normalised run, by the vocabulary's split pattern."""
    return len(_PIECE.findall(run))


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Token ids, merge ranks and special tokens of a word-end BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.alphabet = byte_alphabet()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.merges[self.ids[left], self.ids[right]] = rank, self.ids[left + right]
        names = {i: token for token, i in chain(self.ids.items(), self.specials.items())}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.digits = [str(i) for i in range(len(self.names))]

    def pieces(self, run: str) -> list[str | int]:
        """Normalised words of a run without white space; ids where special tokens stand."""
        if run.isascii() and "<|" not in run:
            return _PIECE.findall(run.lower())
        found: list[str | int] = []
        for part in self.special.split(run):
            if part in self.specials:
                found.append(self.specials[part])
            elif part:
                # characters are lowered one at a time: no final-sigma rule
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                found += _PIECE.findall(plain)
        return found

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the pair of the lowest rank is merged first, leftmost at ties.

        Pairs wait in a heap and symbols in a linked list, so n symbols take n log n steps.
        """
        symbols = [self.alphabet[b] for b in word.encode()]
        symbols[-1] += self.suffix
        ids, merges, n = [self.ids[s] for s in symbols], self.merges, len(symbols)
        if n == 1:
            return ids
        heap = [(found[0], at, *pair) for at, pair in enumerate(zip(ids, ids[1:])) if (found := merges.get(pair))]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, at, left, right = heappop(heap)
            second = after[at]
            if ids[at] != left or second == n or ids[second] != right:
                continue  # one of the two was merged since
            ids[at], ids[second] = merges[left, right][1], -1
            third = after[at] = after[second]
            if third < n:
                before[third] = at
                if found := merges.get((ids[at], ids[third])):
                    heappush(heap, (found[0], at, ids[at], ids[third]))
            first = before[at]
            if first >= 0 and (found := merges.get((ids[first], ids[at]))):
                heappush(heap, (found[0], first, ids[first], ids[at]))
        return [i for i in ids if i >= 0]


class Lexicon:
    """A minimal acyclic transducer over UTF-8 bytes.

    ``keys`` holds state * 256 + byte of every arc in order, ``targets`` and ``outputs``
    what the arc leads to and adds.  A word's outputs sum to its slot; ``final`` marks
    accepting states; slot s owns ``ids[starts[s]:starts[s + 1]]``.
    """

    FIELDS = ("keys", "targets", "outputs", "final", "starts", "ids")

    def __init__(self, *arrays: np.ndarray):
        self.keys, self.targets, self.outputs, self.final, self.starts, self.ids = arrays

    @classmethod
    def compile(cls, entries: dict[str, list[int]]) -> Lexicon:
        words = sorted((word.encode(), ids) for word, ids in entries.items())
        # A state is [final, {byte: state}]; closed states are shared through the register.
        register: dict[tuple, int] = {}
        closed: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def close(state: list) -> int:
            shape = state[0], tuple(state[1].items())
            number = register.setdefault(shape, len(closed))
            if number == len(closed):
                closed.append(shape)
            return number

        path: list[list] = [[False, {}]]
        before = b""
        for word, _ in words:
            common = len(os.path.commonprefix((before, word)))
            while len(path) > common + 1:
                number = close(path.pop())
                path[-1][1][before[len(path) - 1]] = number
            for _ in word[common:]:
                path.append([False, {}])
            path[-1][0] = True
            before = word
        while len(path) > 1:
            number = close(path.pop())
            path[-1][1][before[len(path) - 1]] = number
        root = close(path[0])
        # states are numbered children first; the root becomes state 0 below
        size = np.zeros(len(closed), np.int64)
        rows = []
        for state, (final, arcs) in enumerate(closed):
            passed = int(final)
            for byte, child in arcs:
                rows.append((root - state, byte, root - child, passed))
                passed += size[child]
            size[state] = passed
        rows.sort()
        arcs = np.array(rows, np.int64).reshape(-1, 4)
        final = np.array([f for f, _ in reversed(closed)], np.uint8)
        starts = np.zeros(len(words) + 1, np.int64)
        starts[1:] = np.cumsum([len(ids) for _, ids in words])
        flat = np.fromiter(chain.from_iterable(ids for _, ids in words), np.int64, int(starts[-1]))
        return cls(arcs[:, 0] * 256 + arcs[:, 1], arcs[:, 2], arcs[:, 3], final, starts, flat)

    def parts(self) -> Iterator[bytes]:
        """The bytes of its file: the lengths of all arrays, then each array."""
        arrays = [np.ascontiguousarray(getattr(self, f), "u1" if f == "final" else "<i8") for f in self.FIELDS]
        yield np.array([len(a) for a in arrays], "<i8").tobytes()
        for array in arrays:
            yield array.tobytes() + b"\0" * (-array.nbytes % 8)

    def save(self, path: str) -> None:
        with open(path, "wb") as file:
            file.writelines(self.parts())

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """Memory-map a saved lexicon."""
        sizes = np.fromfile(path, "<i8", len(cls.FIELDS))
        at, arrays = sizes.nbytes, []
        for field, n in zip(cls.FIELDS, sizes.tolist(), strict=True):
            kind = np.dtype("u1" if field == "final" else "<i8")
            arrays.append(np.memmap(path, kind, "r", at, (n,)) if n else np.empty(0, kind))
            at += -(-n * kind.itemsize // 8) * 8
        return cls(*arrays)

    def slots(self, words: list[bytes]) -> np.ndarray:
        """Slot of each non-empty word, -1 where it is not in the lexicon; all step together."""
        result = np.full(len(words), -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        live = np.arange(len(words) if len(self.keys) else 0)
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            wanted = state[live] * 256 + flat[begins[live] + step]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[at] == wanted
            live, at = live[hit], at[hit]
            state[live] = self.targets[at]
            total[live] += self.outputs[at]
            step += 1
            over = lengths[live] == step
            ended, live = live[over], live[~over]
            result[ended] = np.where(self.final[state[ended]] > 0, total[ended], -1)
        return result

    def ids_of(self, slot: int) -> list[int]:
        return self.ids[self.starts[slot] : self.starts[slot + 1]].tolist()


class Encoder:
    """Encodes texts; looks only runs up in the lexicon that its table does not know."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, known_runs: int = KNOWN_RUNS):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.table = RunTable(self.learn, self.alone, known_runs)

    def learn(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of each run's ids)."""
        pieces = [self.vocabulary.pieces(run) for run in runs]
        words = list({p for found in pieces for p in found if isinstance(p, str)})
        known: dict[str | int, list[int]] = {i: [i] for i in self.vocabulary.specials.values()}
        for word, slot in zip(words, self.lexicon.slots([w.encode() for w in words]).tolist(), strict=True):
            known[word] = self.lexicon.ids_of(slot) if slot >= 0 else self.vocabulary.merge(word)
        ids = [list(chain.from_iterable(map(known.__getitem__, found))) for found in pieces]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def alone(self, text: str) -> np.ndarray:
        return self.learn(split_white(text))[0]

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        return (ids.tolist() for ids in self.table.encode_all(texts))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.vocabulary.names.__getitem__, ids))


def word_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(word, n) of every normalised word of all texts, summed after a per-task pre-count."""
    path = vocabulary or default_vocabulary()
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        spelling, seen = Vocabulary(path), Counter()

        def flush():
            words = Counter()
            for run, n in seen.items():
                for piece in spelling.pieces(run):
                    if isinstance(piece, str):
                        words[piece] += n
            seen.clear()
            return to_batch(schema, (list(words.keys()), list(words.values())))

        for batch in batches:
            for text in text_or_empty(batch, 0):
                seen.update(runs_of(text))
                if len(seen) > COUNTER_WORDS:
                    yield flush()
        yield flush()

    counted = documents.select("text").mapInArrow(tidy(count), "word string, n long")
    # tasks have added up their own words; the partitions follow the data, not the cluster's default
    return counted.repartition(partitions_for(documents), "word").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(documents: DataFrame, vocabulary: str | None = None, size: int = LEXICON_WORDS) -> Lexicon:
    """Compile the ``size`` most frequent words of the corpus (that many rows reach the driver)."""
    spelling = Vocabulary(vocabulary or default_vocabulary())
    top = word_counts(documents, vocabulary).orderBy(F.desc("n"), "word").limit(size).select("word").toArrow()
    return Lexicon.compile({word: spelling.merge(word) for word in top.column(0).to_pylist()})


def publish(documents: DataFrame, lexicon: Lexicon) -> str:
    """Hand the lexicon's file to all executors, also those that join later; its name there.

    The file lies in the shared folder; Spark copies it to each node that asks for it.
    """
    context, path = documents.sparkSession.sparkContext, shared_folder(documents.sparkSession, "lexicon")
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    file = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    try:
        for part in lexicon.parts():
            file.write(bytearray(part))
    finally:
        file.close()
    context.addFile(path)
    return os.path.basename(path)


def stage_encoder(path: str, name: str) -> Encoder:
    """The encoder that the tasks of a stage share in a Python worker."""
    return held_in_stage(("lexicon", path, name), lambda: Encoder(Vocabulary(path), Lexicon.mapped(SparkFiles.get(name))))


def encode(documents: DataFrame, vocabulary: str | None = None, lexicon: Lexicon | None = None) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    path = vocabulary or default_vocabulary()
    name = publish(documents, lexicon or build_lexicon(documents, vocabulary))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        encoder = stage_encoder(path, name)
        for batch in batches:
            yield to_batch(schema, (batch.column(0), list(encoder.encode_all(text_or_empty(batch)))))

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids decode to the empty text."""
    path = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        names = Vocabulary(path).names
        for batch in batches:
            texts = (" ".join(map(names.__getitem__, ids.as_py() or ())) for ids in batch.column(1))
            yield to_batch(schema, (batch.column(0), list(texts)))

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def round_trip_digests(documents: DataFrame, vocabulary: str | None = None, lexicon: Lexicon | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded then decoded."""
    path = vocabulary or default_vocabulary()
    name = publish(documents, lexicon or build_lexicon(documents, vocabulary))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        encoder = stage_encoder(path, name)
        digits = encoder.vocabulary.digits
        for batch in batches:
            counts, first, second = [], [], []
            for ids in encoder.encode_all(text_or_empty(batch)):
                counts.append(len(ids))
                first.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            yield to_batch(schema, (batch.column(0), counts, first, second))

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
