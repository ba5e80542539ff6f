"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Each word enters as a learned word vector beside the mean of its learned character n-gram
vectors.  Two gated recurrent passes read a window of words in both directions, attention
pools their states, and a logistic layer gives the window's score.  Every text is cut into
overlapping windows, all of them are scored, and the highest is the document's score.

The network is trained in numpy on a bounded sample of labelled documents.  Labels are of
whole documents, so each epoch trains a toxic document on the window that looks worst so
far, and a harmless one on its worst window and a random one.

Defined cases: a null or empty text is one window without words and scores the network's
bias; a very long text, or one very long word, is scored whole; of windows that score equally
the text has that score; without labels of both kinds every text scores 0; null labels or ids
train nothing; of two labels of one document the larger counts; repeated rows each give a row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded_labelled_sample, crc32_of_id, text_or_empty, tidy, to_batch
from .word_features import hashed

WINDOW = 24
STRIDE = 12
WORD_BUCKETS = 1 << 14
CHAR_BUCKETS = 1 << 17
#: Lengths of character n-grams, word edges included; chosen by an inner fold of the learnable rows.
CHAR_SIZES = (3, 4, 5)
VECTOR = 8
HIDDEN = 8
ATTENTION = 8
#: At most so many labelled documents of each label are used.
LABELLED_ROWS = 2000
EPOCHS = 10
#: Few labels are gone through more often, up to this many steps or epochs.
LEAST_STEPS = 600
MOST_EPOCHS = 50
BATCH = 64
RATE = 0.004
THRESHOLD = 0.5
FOLDS, HELD_OUT = 5, 0
MEMO_WORDS = 1 << 18
TOGETHER_WORDS = 1 << 17
BATCH_WINDOWS = 1 << 11
TOGETHER_FEATURES = 1 << 14

_SPACED = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[str]:
    """Lower-case words; ASCII punctuation separates them."""
    return text.lower().encode().translate(_SPACED).decode().split()


def window_starts(n: int) -> range:
    """Starts of the overlapping windows of a text; the last one ends with the text."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def glorot(chance: np.random.Generator, *shape: int) -> np.ndarray:
    return (chance.standard_normal(shape) * np.sqrt(2 / sum(shape))).astype(np.float32)


@dataclass
class Network:
    words: np.ndarray
    chars: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> Network:
        chance = np.random.default_rng(seed)
        p = {}
        for side in "fb":
            p["W" + side] = glorot(chance, 2 * VECTOR, 3 * HIDDEN)
            p["U" + side] = glorot(chance, HIDDEN, 3 * HIDDEN)
            p["b" + side] = np.zeros(3 * HIDDEN, np.float32)
        p["A"] = glorot(chance, 2 * HIDDEN, ATTENTION)
        p["a"] = np.zeros(ATTENTION, np.float32)
        p["v"] = glorot(chance, ATTENTION)
        p["o"] = glorot(chance, 2 * HIDDEN)
        p["c"] = np.zeros(1, np.float32)
        return cls(*(chance.standard_normal((n, VECTOR)).astype(np.float32) * 0.1 for n in (WORD_BUCKETS, CHAR_BUCKETS)), p)

    def inputs(self, features: WordFeatures) -> np.ndarray:
        """A row per word: its word vector, then the mean of its character vectors."""
        rows = np.empty((len(features.words), 2 * VECTOR), self.words.dtype)
        rows[:, :VECTOR] = self.words[features.words]
        for low in range(0, len(rows), TOGETHER_FEATURES):
            starts = features.starts[low : low + TOGETHER_FEATURES + 1]
            sums = np.add.reduceat(self.chars[features.chars[starts[0] : starts[-1]]], starts[:-1] - starts[0], axis=0)
            rows[low : low + TOGETHER_FEATURES, VECTOR:] = sums / np.diff(starts)[:, None]
        return rows

    def states(self, side: str, projected: np.ndarray, mask: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States (B, T, H) of one direction; ``tape`` receives what the backward pass needs."""
        many, steps = mask.shape
        U, H = self.p["U" + side], HIDDEN
        h = np.zeros((many, H), projected.dtype)
        out = np.empty((many, steps, H), projected.dtype)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a, u, m = projected[:, t], h @ U, mask[:, t, None]
            gates = sigmoid(a[:, : 2 * H] + u[:, : 2 * H])
            r, z = gates[:, :H], gates[:, H:]
            n = np.tanh(a[:, 2 * H :] + r * u[:, 2 * H :])
            new = h + m * (1 - z) * (n - h)
            if tape is not None:
                tape.append((t, h, r, z, n, u[:, 2 * H :], m))
            h = new
            out[:, t] = h
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(logits, attention, pooled states, keys)."""
        p = self.p
        keys = np.tanh(states @ p["A"] + p["a"])
        scores = np.where(mask > 0, keys @ p["v"], -1e9)
        weights = np.exp(scores - scores.max(axis=1, keepdims=True)) * mask
        weights = weights / np.maximum(weights.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("bt,bth->bh", weights, states)
        return pooled @ p["o"] + p["c"], weights, pooled, keys

    def logits(self, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate((self.states("f", forward, mask), self.states("b", backward, mask)), axis=2)
        return self.pool(states, mask)[0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the weighted log loss for parameters and inputs, and the loss."""
        p, H = self.p, HIDDEN
        tapes = {"f": [], "b": []}
        sides = {s: self.states(s, x @ p["W" + s] + p["b" + s], mask, tapes[s]) for s in "fb"}
        states = np.concatenate((sides["f"], sides["b"]), axis=2)
        logits, att, pooled, keys = self.pool(states, mask)
        prob = sigmoid(logits)
        total = weight.sum()
        loss = -(weight * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).sum() / total
        d = (prob - y) * weight / total
        g = {"o": d @ pooled, "c": d.sum(keepdims=True)}
        dpool = d[:, None] * p["o"]
        dstates = att[:, :, None] * dpool[:, None, :]
        datt = np.einsum("bh,bth->bt", dpool, states)
        dscore = att * (datt - (att * datt).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("bt,bta->a", dscore, keys)
        dkeys = dscore[:, :, None] * p["v"] * (1 - keys**2)
        g["A"] = np.einsum("bth,bta->ha", states, dkeys)
        g["a"] = dkeys.sum(axis=(0, 1))
        dstates = dstates + dkeys @ p["A"].T
        dx = np.zeros_like(x)
        for side in "fb":
            W, U = p["W" + side], p["U" + side]
            dW, dU, db = np.zeros_like(W), np.zeros_like(U), np.zeros_like(p["b" + side])
            own = dstates[:, :, :H] if side == "f" else dstates[:, :, H:]
            dh = np.zeros((len(x), H), x.dtype)
            for t, h, r, z, n, un, m in reversed(tapes[side]):
                dh = dh + own[:, t]
                live = m * dh
                dn, dz = live * (1 - z), live * (h - n)
                dan = dn * (1 - n**2)
                da = np.hstack((dan * un * r * (1 - r), dz * z * (1 - z), dan))
                du = np.hstack((da[:, : 2 * H], dan * r))
                dU += h.T @ du
                dW += x[:, t].T @ da
                db += da.sum(axis=0)
                dx[:, t] += da @ W.T
                dh = dh * (1 - m) + live * z + du @ U.T
            g |= {"W" + side: dW, "U" + side: dU, "b" + side: db}
        return g, dx, float(loss)


@dataclass
class WordFeatures:
    """Buckets of some words: one word bucket each, and a run of character buckets."""

    words: np.ndarray
    chars: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> WordFeatures:
        own, chars, starts = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        for low in range(0, len(words), TOGETHER_FEATURES):
            feature, begins = hashed(words[low : low + TOGETHER_FEATURES], WORD_BUCKETS * CHAR_BUCKETS, CHAR_SIZES)
            own.append((feature[begins[1:] - 1] % WORD_BUCKETS).astype(np.int32))  # the whole word comes last
            chars.append((feature // WORD_BUCKETS).astype(np.int32))
            starts.append(begins[1:] + starts[-1][-1])
        return cls(np.concatenate(own), np.concatenate(chars), np.concatenate(starts))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts).astype(np.float32)

    def chars_of(self, words: np.ndarray) -> np.ndarray:
        """The character buckets of some words, one run after the other."""
        lengths = self.starts[words + 1] - self.starts[words]
        before = np.cumsum(lengths) - lengths
        return self.chars[np.repeat(self.starts[words] - before, lengths) + np.arange(int(lengths.sum()))]


@dataclass
class Model:
    network: Network
    shift: float = 0.0
    constant: bool = False

    def document_logits(self, rows: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Highest window logit of each document, from the input rows of all their words."""
        net = self.network
        blank = np.zeros((WINDOW, rows.shape[1]), rows.dtype)
        padded = np.vstack((rows, blank))
        sides = [padded @ net.p["W" + s] + net.p["b" + s] for s in "fb"]
        begins, owners, ends = [], [], []
        at = 0
        for k, n in enumerate(lengths):
            starts = window_starts(n)
            begins += [at + s for s in starts]
            owners += [k] * len(starts)
            at += n
            ends += [at] * len(starts)
        begins, owners, ends = np.array(begins), np.array(owners), np.array(ends)
        best = np.full(len(lengths), -np.inf)
        steps = np.arange(WINDOW)
        for low in range(0, len(begins), BATCH_WINDOWS):
            part = slice(low, low + BATCH_WINDOWS)
            places = begins[part, None] + steps
            mask = (places < ends[part, None]).astype(rows.dtype)
            logits = net.logits(sides[0][places], sides[1][places], mask)
            np.maximum.at(best, owners[part], logits)
        return best + self.shift


def suspicion(features: WordFeatures, documents: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """How much more often each word's features stand in toxic documents: a first guess."""
    seen = np.zeros((2, CHAR_BUCKETS))
    for words, label in zip(documents, y, strict=True):
        seen[int(label), np.unique(features.chars_of(np.unique(words)))] += 1
    documents_of = np.bincount(y, minlength=2)
    expected = seen.sum(axis=0) * documents_of[1] / max(1, len(y))
    surprise = (seen[1] - expected) / np.sqrt(expected + 1)
    return np.maximum(np.maximum.reduceat(surprise[features.chars], features.starts[:-1]) - 1, 0).astype(np.float32)


def shared_buckets(features: WordFeatures, documents: list[np.ndarray]) -> list[np.ndarray]:
    """Which word and character buckets stand in two training documents or more.

    What one document alone has, or none, keeps a zero vector: it can't be learnt from.
    """
    counts = [np.zeros(WORD_BUCKETS, np.int32), np.zeros(CHAR_BUCKETS, np.int32)]
    for words in documents:
        own = np.unique(words)
        counts[0][np.unique(features.words[own])] += 1
        counts[1][np.unique(features.chars_of(own))] += 1
    return [c > 1 for c in counts]


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Model:
    net = Network.fresh(seed)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(net, constant=True)
    vocabulary: dict[str, int] = {}
    documents = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t in texts]
    features = WordFeatures.of(list(vocabulary))
    del vocabulary
    shared = shared_buckets(features, documents)
    for vectors, known in zip((net.words, net.chars), shared, strict=True):
        vectors[~known] = 0
    first = suspicion(features, documents, labels)
    chance = np.random.default_rng(seed)
    lengths = [len(d) for d in documents]
    flat = np.concatenate(documents)
    begins = np.cumsum([0, *lengths])
    starts = [np.array(window_starts(n)) for n in lengths]
    steps = np.arange(WINDOW)
    where = np.concatenate([s + b for s, b in zip(starts, begins, strict=False)])
    owner = np.repeat(np.arange(len(documents)), [len(s) for s in starts])
    places = where[:, None] + steps
    mask_all = (places < begins[owner + 1][:, None]).astype(np.float32)
    ids_all = np.append(flat, np.zeros(WINDOW, np.int32))[np.minimum(places, len(flat))]
    del places
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    squares = [np.full(n, 1e-6, np.float32) for n in (WORD_BUCKETS, CHAR_BUCKETS)]
    # windows of one document are adjacent: the worst is the maximum of its run
    runs = np.cumsum([0, *(len(s) for s in starts)])
    epochs = min(MOST_EPOCHS, max(epochs, LEAST_STEPS * BATCH // (len(labels) + int((labels == 0).sum()))))
    step = 0
    for epoch in range(epochs):
        if epoch * 3 < epochs:
            rating = (mask_all * first[ids_all]).sum(axis=1)
        else:
            rating = np.empty(len(where), np.float32)
            x = net.inputs(features)
            sides = [x @ net.p["W" + s] + net.p["b" + s] for s in "fb"]
            for low in range(0, len(where), BATCH_WINDOWS):
                part = slice(low, low + BATCH_WINDOWS)
                rating[part] = net.logits(sides[0][ids_all[part]], sides[1][ids_all[part]], mask_all[part])
        order = np.lexsort((rating, owner))
        worst = order[runs[1:] - 1]
        harmless = np.flatnonzero(labels == 0)
        other = runs[harmless] + (chance.random(len(harmless)) * (runs[harmless + 1] - runs[harmless])).astype(np.int64)
        chosen = np.concatenate((worst, other))
        target = np.concatenate((labels, np.zeros(len(harmless)))).astype(np.float32)
        weight = np.concatenate((np.ones(len(labels), np.float32), np.full(len(harmless), 0.5, np.float32)))
        rate = RATE * (1 - 0.8 * epoch / epochs)
        for part in np.array_split(chance.permutation(len(chosen)), max(1, len(chosen) // BATCH)):
            rows = chosen[part]
            ids, inverse = np.unique(ids_all[rows], return_inverse=True)
            inverse = inverse.reshape(len(rows), WINDOW)
            lens = np.diff(features.starts)[ids]
            local = WordFeatures(features.words[ids], features.chars_of(ids), np.concatenate(([0], np.cumsum(lens))))
            x = net.inputs(local)
            mask = mask_all[rows]
            g, dx, _ = net.gradients(x[inverse], mask, target[part], weight[part])
            step += 1
            for k, grad in g.items():
                m, s = moments[k]
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            dwords = np.zeros_like(x)
            np.add.at(dwords, inverse.reshape(-1), (dx * mask[:, :, None]).reshape(-1, x.shape[1]))
            spread = np.repeat(dwords[:, VECTOR:] / local.counts[:, None], lens, axis=0)
            for vectors, square, known, at, grad in ((net.words, squares[0], shared[0], local.words, dwords[:, :VECTOR]), (net.chars, squares[1], shared[1], local.chars, spread)):
                at, grad = at[known[at]], grad[known[at]]
                touched, back = np.unique(at, return_inverse=True)
                sums = np.zeros((len(touched), VECTOR), np.float32)
                np.add.at(sums, back, grad)
                square[touched] += (sums**2).mean(axis=1)
                vectors[touched] -= 12 * rate * sums / np.sqrt(square[touched])[:, None]
    model = Model(net)
    rows = net.inputs(features)
    logits = np.concatenate([model.document_logits(rows[flat[begins[k] : begins[min(k + 256, len(lengths))]]], lengths[k : k + 256]) for k in range(0, len(lengths), 256)])
    model.shift = -best_cut(logits, labels)
    return model


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the fewest wrong labels, in the middle of its gap."""
    order = np.argsort(logits)
    ranked, y = logits[order], labels[order]
    wrong = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))
    k = int(wrong.argmin())
    edges = np.concatenate(([ranked[0] - 2], ranked, [ranked[-1] + 2]))
    return float((edges[k] + edges[k + 1]) / 2)


def fit(documents: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> Model:
    """Learn from at most ``limit`` rows of each label outside the held-out fold."""
    learnable = crc32_of_id() % FOLDS != HELD_OUT
    rows = []
    for value in (0, 1):
        part = bounded_labelled_sample(documents, labels, "toxic", limit, learnable, value).toArrow()
        rows += zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True)
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    return train([t or "" for _, t, _ in rows], np.array([y for _, _, y in rows], np.int64))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        model = shared.value
        width = 2 * VECTOR

        def learn(new):
            words = list(new)
            raw = np.ascontiguousarray(model.network.inputs(WordFeatures.of(words)), np.float32).tobytes()
            return {w: raw[k * 4 * width : (k + 1) * 4 * width] for k, w in enumerate(words)}

        memo = Memo(learn, MEMO_WORDS)

        def rated(ids, lengths, words):
            rows = np.frombuffer(b"".join(memo.recall(words)), np.float32).reshape(-1, width)
            logits = model.document_logits(rows, lengths)
            scores = np.zeros(len(ids)) if model.constant else sigmoid(logits.astype(np.float64))
            return to_batch(schema, (ids, scores))

        ids, lengths, words = [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), text_or_empty(batch), strict=True):
                own = words_of(text)
                ids.append(doc_id.as_py())
                lengths.append(len(own))
                words += own
                if len(words) > TOGETHER_WORDS:
                    yield rated(ids, lengths, words)
                    ids, lengths, words = [], [], []
        if ids:
            yield rated(ids, lengths, words)

    shown = documents.select(F.col("doc_id").cast("long"), "text")
    held_out = F.coalesce(crc32_of_id() % FOLDS == HELD_OUT, F.lit(False))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return shown.mapInArrow(tidy(run), "doc_id long, score double").select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, fit(documents, labels))
