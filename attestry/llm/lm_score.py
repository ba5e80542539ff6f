"""Masked pseudo-likelihood scores from a bidirectional window network.

Every word of a text is predicted from the two words on each side of it.  The network looks
up one learned vector per neighbour, mixes them by place, squashes the sum, and predicts the
word in two softmax steps: one of 64 classes, then one of 64 cells of that class.  Classes
and cells are even shares of the corpus in order of frequency, so a frequent word has a cell
to itself; words that share a cell divide it by their counts.  A document's score is the sum
over all its words of the log-probability of the word given its neighbours.

Everything is gathered from the whole corpus and grows with it.  Words are counted exactly,
in a table in the shared folder that never reaches the driver.  The most frequent ones are
the network's own words; their number grows with the square root of the number of different
words (``own_words``), which bounds what is broadcast.  All other words are one cell, divided
by their exact counts: the documents' rare words are joined with the table of counts.

Training deals the documents by hash into groups of about ``GROUP_WORDS`` words, whatever
their partitions were, and trains a copy of the weights on every word of each group.  The
copies are averaged on the executors, a vector by those that met it, by the words they saw.

Defined cases: words are runs of bytes without white space, A-Z counted as a-z; a null or
empty text has no words, a sum of zero and a null mean; a very long text is scored whole, by
steps of bounded size; repeated rows each give a row; words of equal counts are ordered by
hash; a word never seen counts as seen once; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, stored, text_or_empty, tidy, to_batch
from .hashing import Hasher

PLACES = (-2, -1, 1, 2)
LEAST_INPUTS = 4096
BRANCHES = 64
HIDDEN = 16
ROUNDS = 1
STEP_WORDS = 8192
GROUP_WORDS = 1 << 23
RATE = 0.1
BATCH_BYTES = 1 << 21
#: Different words that a task holds before it hands on their counts; vectors in a piece.
HELD_WORDS = 1 << 20
PIECE = 1 << 12

OUTSIDE = 1


def inputs_for(distinct: int) -> int:
    """Vectors for so many different words: 64 times the square root, as a power of two."""
    return max(LEAST_INPUTS, 1 << max(0, 64 * isqrt(max(0, distinct)) - 1).bit_length())


def own_words(inputs: int) -> int:
    """Words that have a vector to themselves; the others share the other half by hash."""
    return inputs // 2 - 2


class Words:
    """The network's own words: their hashes, vectors, cells and shares.

    ``hashes`` are sorted; the number of hashes below each prefix leads to the place of one.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, inputs: int):
        rank = np.lexsort((hashes.view(np.int64), -counts))
        self.inputs, self.rare_total = inputs, int(total - counts.sum())
        hashes, counts = hashes[rank], counts[rank].astype(np.float64)
        mass = np.append(counts, self.rare_total)  # all other words stand last, as one
        middle = np.cumsum(mass) - mass / 2
        cell = np.minimum((middle / max(1, total) * BRANCHES**2).astype(np.int32), BRANCHES**2 - 1)
        self.cell_mass = np.bincount(cell, mass, BRANCHES**2)
        share = np.log(np.maximum(mass, 1e-9) / np.maximum(self.cell_mass[cell], 1e-9)).astype(np.float32)
        order = np.argsort(hashes)
        self.hashes = np.append(hashes[order], np.uint64((1 << 64) - 1))
        self.input = np.append(2 + order, 0).astype(np.int32)
        self.cell = np.append(cell[:-1][order], cell[-1]).astype(np.int16)
        self.log_share = np.append(share[:-1][order], share[-1])
        self.shift = np.uint64(64 - (16 * max(2, len(hashes))).bit_length())
        prefixes = np.arange(1 << int(64 - self.shift), dtype=np.uint64)
        self.below = np.searchsorted(self.hashes[:-1], prefixes << self.shift).astype(np.int32)
        self.most = int(np.diff(np.append(self.below, len(hashes))).max(initial=0))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word; one past the end for all that are not own words."""
        at = self.below[hashes >> self.shift]
        for _ in range(self.most):
            at = at + (self.hashes[at] < hashes)
        return np.where(self.hashes[at] == hashes, at, len(self.hashes) - 1)

    def inputs_of(self, hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
        half = self.inputs // 2
        shared = half + ((hashes >> np.uint64(20)) % np.uint64(self.inputs - half)).astype(np.int32)
        return np.where(places < len(self.hashes) - 1, self.input[places], shared)


SHAPES = {
    "b": (HIDDEN,), "W": (len(PLACES) * HIDDEN, HIDDEN), "O": (HIDDEN, BRANCHES), "c": (BRANCHES,),
    "P": (BRANCHES, HIDDEN, BRANCHES), "d": (BRANCHES, BRANCHES),
}
#: Floats beside the inputs' vectors, which come last.
DENSE = sum(int(np.prod(shape)) for shape in SHAPES.values())


class Network:
    """Weights in one flat array: ``O`` and ``c`` give the class, ``P`` and ``d`` the cell of
    each class, ``E`` a vector per input, ``W`` and ``b`` the hidden layer."""

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in {**SHAPES, "E": ((len(flat) - DENSE) // HIDDEN, HIDDEN)}.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def fresh(cls, words: Words, seed: int = 5) -> Network:
        """Random vectors; the biases alone give every cell its share of the corpus."""
        chance = np.random.default_rng(seed)
        net = cls(np.zeros(DENSE + words.inputs * HIDDEN, np.float32))
        net.E[:] = 0.3 * chance.standard_normal(net.E.shape)
        net.W[:] = chance.standard_normal(net.W.shape) / np.sqrt(len(net.W))
        cells = words.cell_mass.reshape(BRANCHES, BRANCHES)
        classes = cells.sum(axis=1)
        net.c[:] = np.log(np.maximum(classes, 1e-6) / max(1.0, classes.sum()))
        net.d[:] = np.log(np.maximum(cells, 1e-6) / np.maximum(classes, 1e-6)[:, None])
        np.maximum(net.flat[:DENSE], -20, out=net.flat[:DENSE])
        return net

    def forward(self, around: np.ndarray, cells: np.ndarray):
        """(vectors, hidden, order by class, bounds of classes, odds and log-probability of both steps)."""
        vectors = self.E[around].reshape(len(around), -1)
        hidden = np.tanh(vectors @ self.W + self.b)
        classes, within = cells // BRANCHES, cells % BRANCHES
        order = np.argsort(classes, kind="stable")
        bounds = np.searchsorted(classes[order], np.arange(BRANCHES + 1)).tolist()
        vectors, hidden, classes, within = vectors[order], hidden[order], classes[order], within[order]
        first, second = hidden @ self.O + self.c, np.empty((len(hidden), BRANCHES), np.float32)
        for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if high > low:
                np.add(hidden[low:high] @ self.P[k], self.d[k], out=second[low:high])
        rows, logs = np.arange(len(hidden)), np.zeros(len(hidden), np.float32)
        for scores, wanted in ((first, classes), (second, within)):
            scores -= scores.max(axis=1, keepdims=True)
            own = scores[rows, wanted]
            np.exp(scores, out=scores)
            total = scores.sum(axis=1, keepdims=True)
            scores /= total
            logs += own - np.log(total[:, 0])
        return vectors, hidden, order, bounds, classes, within, first, second, logs

    def log_probabilities(self, around: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Log-probability of each word's cell; ``around`` has a column per place."""
        result = np.empty(len(cells), np.float32)
        for low in range(0, len(cells), STEP_WORDS):
            *_, order, _, _, _, _, _, logs = self.forward(around[low : low + STEP_WORDS], cells[low : low + STEP_WORDS])
            result[low + order] = logs
        return result

    def gradients(self, around: np.ndarray, cells: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Of the mean loss: one per dense weight, and the inputs met with one per vector."""
        n = len(cells)
        vectors, hidden, order, bounds, classes, within, first, second, _ = self.forward(around, cells)
        rows = np.arange(n)
        first[rows, classes] -= 1
        second[rows, within] -= 1
        back = first @ self.O.T
        grads = {"O": hidden.T @ first / n, "c": first.mean(axis=0), "P": np.zeros_like(self.P), "d": np.zeros_like(self.d)}
        for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if high > low:
                part = second[low:high]
                grads["P"][k], grads["d"][k] = hidden[low:high].T @ part / n, part.sum(axis=0) / n
                back[low:high] += part @ self.P[k].T
        back *= 1 - hidden * hidden
        grads |= {"W": vectors.T @ back / n, "b": back.mean(axis=0)}
        spread = (back @ self.W.T).reshape(-1, HIDDEN)
        ids = around[order].reshape(-1)
        by_id = np.argsort(ids, kind="stable")
        ids = ids[by_id]
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        return grads, ids[starts], np.add.reduceat(spread[by_id], starts, axis=0) / np.diff(np.append(starts, len(ids)))[:, None]

    def step(self, around: np.ndarray, cells: np.ndarray, squares: Network) -> None:
        """One gradient step; a weight's step shrinks with the gradients it has seen."""
        grads, met, moved = self.gradients(around, cells)
        for name, grad in grads.items():
            seen, weight = getattr(squares, name), getattr(self, name)
            seen += grad * grad
            weight -= RATE * grad / (np.sqrt(seen) + 1e-6)
        seen = squares.E[met] + moved * moved
        squares.E[met] = seen
        self.E[met] -= RATE * moved / (np.sqrt(seen) + 1e-3)


def batches_of_words(batches, column: int):
    """(rows of the batch, hash of each word, number of words of each row) some rows at a time."""
    hasher = Hasher()
    for batch in batches:
        texts, size, first = [], 0, 0
        for row, text in enumerate(text_or_empty(batch, column)):
            texts.append(text.encode())
            size += len(texts[-1])
            if size > BATCH_BYTES or row + 1 == batch.num_rows:
                raw = np.frombuffer(b" ".join(texts), np.uint8)
                hashes, starts = hasher.words(raw)
                bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
                yield batch.slice(first, len(texts)), hashes, np.diff(bounds)
                texts, size, first = [], 0, row + 1


def neighbours(inputs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Inputs of the words around every word, a column per place."""
    ends = np.cumsum(lengths)
    low, high, at = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths), np.arange(len(inputs))
    around = np.full((len(inputs), len(PLACES)), OUTSIDE, np.int32)
    for k, place in enumerate(PLACES):
        there = at + place
        inside = (there >= low) & (there < high)
        around[inside, k] = inputs[there[inside]]
    return around


def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, sum of the counts of each)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def count_words(documents: DataFrame) -> DataFrame:
    """(word, n): the exact count of every word, by the 64 bits of its hash."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches):
        words, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for _, hashes, _ in batches_of_words(batches, 0):
            new = np.unique(hashes, return_counts=True)
            words, counts = added_up(np.concatenate((words, new[0])), np.concatenate((counts, new[1])))
            if len(words) > HELD_WORDS:
                yield to_batch(schema, (words.view(np.int64), counts))
                words, counts = words[:0], counts[:0]
        yield to_batch(schema, (words.view(np.int64), counts))

    counted = documents.select("text").mapInArrow(tidy(run), "word long, n long")
    # tasks have added up their own words; the partitions follow the data
    return stored(counted.repartition(partitions_for(documents), "word").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def choose_words(counts: DataFrame) -> tuple[Words, int]:
    """The network's own words, and the number of all words of the corpus."""
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    inputs = inputs_for(distinct)
    top = counts.orderBy(F.desc("n"), "word").limit(own_words(inputs)).toArrow()
    hashes = top.column("word").to_numpy().astype(np.int64).view(np.uint64)
    return Words(hashes, top.column("n").to_numpy(), int(total), inputs), int(total)


def round_of_training(documents: DataFrame, groups: int, words: Words, weights: np.ndarray) -> np.ndarray:
    """Train a copy of the weights on every word of each group of documents and average the copies."""
    shared = documents.sparkSession.sparkContext.broadcast((words, weights))
    parts = pa.schema([("piece", pa.int32()), ("n", pa.float64()), ("rows", pa.binary()), ("moved", pa.binary())])

    def run(batches):
        words, weights = shared.value
        net, squares, seen = Network(weights.copy()), Network(np.zeros(len(weights), np.float32)), 0
        around, cells, held = [], [], 0

        def learn():
            a, c = np.concatenate(around), np.concatenate(cells)
            for low in range(0, len(c), STEP_WORDS):
                net.step(a[low : low + STEP_WORDS], c[low : low + STEP_WORDS], squares)

        for _, hashes, lengths in batches_of_words(batches, 0):
            places = words.places(hashes)
            around.append(neighbours(words.inputs_of(hashes, places), lengths))
            cells.append(words.cell[places])
            held += len(places)
            if held >= 16 * STEP_WORDS:
                learn()
                seen, around, cells, held = seen + held, [], [], 0
        if held:
            learn()
        seen += held
        if seen:
            yield to_batch(parts, ([-1], [float(seen)], [b""], [(net.flat[:DENSE] - weights[:DENSE]).tobytes()]))
            old = Network(weights).E
            for piece, low in enumerate(range(0, len(old), PIECE)):
                rows = np.flatnonzero(squares.E[low : low + PIECE].any(axis=1)).astype(np.int32)
                if len(rows):
                    yield to_batch(parts, ([piece], [float(seen)], [rows.tobytes()], [(net.E[low + rows] - old[low + rows]).tobytes()]))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, n, rows, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                moved = np.frombuffer(raw, np.float32).reshape(-1, HIDDEN).astype(np.float64) * n
                at = np.frombuffer(rows, np.int32) if piece >= 0 else np.arange(len(moved))
                total = sums.setdefault(piece, np.zeros((PIECE if piece >= 0 else len(moved), HIDDEN + 1)))
                total[at, :HIDDEN] += moved
                total[at, HIDDEN] += n
        for piece, total in sums.items():
            mean = total[:, :HIDDEN] / np.maximum(total[:, HIDDEN:], 1)
            yield to_batch(parts, ([piece], [0.0], [b""], [mean.astype(np.float32).tobytes()]))

    shape = "piece int, n double, rows binary, moved binary"
    key = F.xxhash64("doc_id", "text")
    dealt = documents.select("text", key.alias("dealt")).repartition(groups, "dealt").sortWithinPartitions("dealt", "text")
    copies = dealt.select("text").mapInArrow(tidy(run), shape)
    pieces = 1 + -(-(len(weights) - DENSE) // (PIECE * HIDDEN))
    found = copies.repartition(pieces, "piece").mapInArrow(tidy(add), shape).select("piece", "moved").toArrow()
    shared.unpersist()
    weights = weights.copy()
    for piece, raw in zip(found.column(0).to_pylist(), found.column(1), strict=True):
        at = slice(0, DENSE) if piece < 0 else slice(DENSE + piece * PIECE * HIDDEN, DENSE + (piece + 1) * PIECE * HIDDEN)
        weights[at] += np.frombuffer(raw.as_buffer(), np.float32)[: len(weights[at])]
    return weights


@dataclass
class Model:
    """Own words and weights, which are broadcast; the counts of all words, which are joined."""

    words: Words
    weights: np.ndarray
    counts: DataFrame


def fit(documents: DataFrame, rounds: int = ROUNDS) -> Model:
    counts = count_words(documents)
    words, total = choose_words(counts)
    weights = Network.fresh(words).flat
    for _ in range(rounds):
        weights = round_of_training(documents, max(1, -(-total // GROUP_WORDS)), words, weights)
    return Model(words, weights, counts)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast((model.words, model.weights))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.float64()), ("rare", pa.list_(pa.int64()))])

    def run(batches):
        words, weights = shared.value
        net, log_rare = Network(weights), np.log(max(1, words.rare_total))
        for batch, hashes, lengths in batches_of_words(batches, 1):
            places = words.places(hashes)
            logs = net.log_probabilities(neighbours(words.inputs_of(hashes, places), lengths), words.cell[places]) + words.log_share[places]
            rare = places == len(words.hashes) - 1
            sums = np.concatenate(([0.0], np.cumsum(logs - log_rare * rare, dtype=np.float64)))
            ends = np.cumsum(lengths)
            edges = np.concatenate(([0], np.cumsum(rare)))[np.concatenate(([0], ends))]
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(hashes[rare].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(sums[ends] - sums[ends - lengths]), lists], schema=schema)

    shown = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, known double, rare array<long>")
    rows = stored(shown.withColumn("row", F.monotonically_increasing_id()), "known-words")
    # a word that stands once adds log 1 to the sum
    often = model.counts.where("n > 1")
    shares = rows.select("row", F.explode("rare").alias("word")).join(often, "word").groupBy("row").agg(F.sum(F.log("n")).alias("shares"))
    joined = rows.select("row", "doc_id", "n_tokens", "known").join(shares, "row", "left")
    summed = joined.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("shares", F.lit(0.0))).alias("log_likelihood"))
    return summed.withColumn("mean_log_likelihood", F.col("log_likelihood") / F.nullif(F.col("n_tokens"), F.lit(0)))


def scored(documents: DataFrame) -> DataFrame:
    return score(documents, fit(documents))
