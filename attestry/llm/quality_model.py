"""Supervised subword embeddings: a quality score per document.

Each word's vector is the mean of the learned vectors of its hashed character n-grams and of
the word itself; a document's vector is the mean over its words, among them one mark for
every word that repeats the word before it; a softmax layer gives the label.  Vectors and
layer are trained by plain numpy stochastic gradient descent on a bounded sample of labelled
rows.  Since the layer is linear in the vectors, a trained model scores a word by one
number, and scoring a text is a mean of remembered numbers.

Defined cases: a null or empty text scores what the layer's bias gives; a very long text, or
one very long word, is scored whole; without labels every text scores 0.5, and with labels of
one kind the score of a bias of plus or minus 4; a null label or id trains nothing; of two
labels of one document the larger counts; equal texts score equally; repeated rows each give a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded_labelled_sample, crc32_of_id, text_or_empty, tidy, to_batch
from .word_features import hashed, means

BUCKETS = 1 << 16
DIMENSION = 8
LABELLED_ROWS = 3000
EPOCHS = 12
RATE = 0.2
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
MEMO_WORDS = 3 << 17
#: Stands for "the same word again"; no text holds it, because it has a space.
AGAIN = "again and again"


def words_of(text: str) -> list[str]:
    return text.split()


def repeats(words: list[str]) -> int:
    return sum(map(str.__eq__, words, words[1:]))


@dataclass
class Model:
    """``bucket_scores``: what each feature adds to the log-odds of label 1; ``bias``."""

    bucket_scores: np.ndarray
    bias: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        return means(words, self.bucket_scores)


def document_features(texts: list[str], together: int = 128) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of each text: its vector is the weighted sum of bucket vectors."""
    rows = []
    for low in range(0, len(texts), together):
        counted = []
        for text in texts[low : low + together]:
            words = words_of(text)
            counted.append(Counter(words) + Counter({AGAIN: repeats(words)}))
        vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for c in counted for w in c))}
        feature, starts = hashed(list(vocabulary), BUCKETS)
        share = np.repeat(1 / np.diff(starts), np.diff(starts)) if len(vocabulary) else np.empty(0)
        for counts in counted:
            own = [vocabulary[w] for w in counts]
            total = sum(counts.values()) or 1
            at = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in own]) if own else np.empty(0, np.int64)
            weight = np.repeat(np.fromiter(counts.values(), float, len(own)) / total, [starts[k + 1] - starts[k] for k in own])
            sums = np.bincount(feature[at], weight * share[at], BUCKETS) if own else np.zeros(BUCKETS)
            used = np.flatnonzero(sums)
            rows.append((used.astype(np.uint16 if BUCKETS <= 1 << 16 else np.int32), sums[used].astype(np.float32)))
    return rows


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Stochastic gradient descent over vectors and softmax layer, one document at a time."""
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if not len(labels) else 4.0 * (2 * int(labels[0]) - 1))
    rows = document_features(texts)
    chance = np.random.default_rng(seed)
    vectors = chance.uniform(-1, 1, (BUCKETS, DIMENSION)).astype(np.float32) / DIMENSION
    layer = np.zeros((DIMENSION, 2), np.float32)
    bias = np.log(np.maximum(np.bincount(labels, minlength=2), 1) / len(labels)).astype(np.float32)
    squares = np.full(BUCKETS, 1e-4, np.float32)  # of gradients, per bucket: rare features take larger steps
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for k in chance.permutation(len(rows)):
            used, weight = rows[k]
            if not len(used):
                continue
            hidden = weight @ vectors[used]
            scores = hidden @ layer + bias
            odds = np.exp(scores - scores.max())
            wrong = odds / odds.sum()
            wrong[labels[k]] -= 1
            back = layer @ wrong
            layer -= rate * np.outer(hidden, wrong)
            bias -= 0.1 * rate * wrong
            squares[used] += (weight * np.abs(back).max()) ** 2
            vectors[used] -= (rate * weight / np.sqrt(squares[used]))[:, None] * back
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(documents: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> Model:
    """Learn from at most ``limit`` labelled rows outside the held-out fold."""
    learnable = crc32_of_id() % FOLDS != HELD_OUT
    rows = bounded_labelled_sample(documents, labels, "quality", limit, learnable).toArrow().sort_by([("doc_id", "ascending")])
    return train([t or "" for t in rows.column("text").to_pylist()], rows.column("y").to_numpy().astype(np.int64))


def logistic(x: float) -> float:
    return 1 / (1 + exp(-x)) if x > -500 else 0.0


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        model = shared.value

        def learn(new):
            words = list(new)
            return dict(zip(words, model.word_scores(words).tolist(), strict=True))

        memo, again = Memo(learn, MEMO_WORDS), float(model.word_scores([AGAIN])[0])
        for batch in batches:
            scores = []
            for text in text_or_empty(batch):
                words = words_of(text)
                same = repeats(words)
                total = sum(memo.recall(words)) + same * again
                scores.append(logistic(model.bias + total / (len(words) + same)) if words else logistic(model.bias))
            yield to_batch(schema, (batch.column(0), scores))

    shown = documents.select(F.col("doc_id").cast("long"), "text")
    held_out = F.coalesce(crc32_of_id() % FOLDS == HELD_OUT, F.lit(False))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return shown.mapInArrow(tidy(run), "doc_id long, score double").select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, fit(documents, labels))
