"""Benchmark decontamination by spaced seeds.

Fixed masks look at five of up to nine neighbouring words and ignore the rest, so a seed
survives substituted words at the ignored places.  Seed hashes of the benchmark are joined
with those of the documents, and around every hit the aligned words are compared.  A leak is
an ungapped alignment in which at least ``MATCHED`` of ``WINDOW`` words are equal.  The four
masks together hit every such alignment, whichever words are substituted.

Both sides of the join are tables, so the benchmark may have any size.  What is broadcast is
a bit per seed of the benchmark, ``FILTER_BITS`` bits whatever it holds: a document's seed
that has no bit set cannot match and is not shuffled.  A seed that many documents share is a
frequent join key, which adaptive execution splits; within one text equal surroundings of a
seed count once, so repeated words do not multiply.

Defined cases: words are lower-cased and ASCII punctuation separates them; items of fewer
than ``WINDOW`` words must be matched in the same proportion over their whole length, for
which the words that may then remain are masks of their own where the four miss them; null or
empty texts on either side match nothing; a very long text is compared whole; benchmark items
of equal words are compared once and reported each; of windows that match equally well the
first counts; repeated documents each give their rows; a null doc_id or item_id is carried as
null; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty, tidy, to_batch
from .hashing import Hasher, mix

#: Word positions that each mask looks at.
MASKS = ((0, 1, 3, 4, 5), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7), (0, 1, 5, 7, 8))
WINDOW = 13
MATCHED = 10
FILTER_BITS = 1 << 24
BATCH_BYTES = 1 << 21
#: Words on each side of a hit that a window around it can reach.
REACH = np.arange(1 - WINDOW, WINDOW)

_SPACED = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bits of one bitmap of Spark's bitmap functions.
_BITMAP = 1 << 15


def plain_words(text: str) -> bytes:
    return text.lower().encode().translate(_SPACED)


def words_of(text: str) -> list[bytes]:
    return plain_words(text).split()


@cache
def short_masks(length: int) -> tuple[tuple[int, ...], ...]:
    """Masks for an item of fewer than ``WINDOW`` words: what is left of it by substitutions that the others miss."""
    own = []
    for kept in combinations(range(length), needed(length)):
        if not any({at + offset for offset in mask} <= set(kept) for mask in MASKS for at in range(length)):
            own.append(kept)
    return tuple(own)


def needed(length: int) -> int:
    """Equal words that a window over a text of so many words must have."""
    return MATCHED if length >= WINDOW else -(-length * MATCHED // WINDOW)


def seed_hashes(words: np.ndarray, at: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A hash of the words that a mask looks at, and of the mask, as signed integers."""
    hashes = np.full(len(at), int.from_bytes(bytes(mask), "little") % (1 << 64), np.uint64)
    for offset in mask:
        hashes = (hashes ^ words[at + offset]) * _FACTOR
        hashes ^= hashes >> np.uint64(31)
    return mix(hashes).view(np.int64)


def padded_words(texts: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes with ``WINDOW`` zeros before, between and after the texts, start of each text, its words)."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    words, starts = hasher.words(raw)
    edges = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    lengths = np.diff(edges)
    begins = np.cumsum(lengths + WINDOW) - lengths
    flat = np.zeros(len(words) + WINDOW * (len(texts) + 1), np.uint64)
    flat[np.repeat(begins - edges[:-1], lengths) + np.arange(len(words))] = words | np.uint64(1)
    return flat, begins, lengths


def places(flat: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Positions at which no word that the mask looks at lies outside of its text."""
    n = max(0, len(flat) - mask[-1])
    inside = np.ones(n, bool)
    for offset in {mask[0], mask[-1]}:
        inside &= flat[offset : offset + n] > 0
    at = np.flatnonzero(inside)
    for offset in mask[1:-1]:
        at = at[flat[at + offset] > 0]
    return at


def once(owner: np.ndarray, seeds: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Rows with equal text, seed and surroundings count once: the first of each."""
    total = np.zeros(len(seeds), np.uint64)
    for column in near.T:
        total = (total ^ column) * _FACTOR
        total ^= total >> np.uint64(31)
    keys = np.stack((owner.astype(np.uint64), seeds.view(np.uint64), total), axis=1)
    return np.sort(np.unique(keys, axis=0, return_index=True)[1]) if len(seeds) else np.empty(0, np.int64)


def surroundings(near: np.ndarray) -> pa.Array:
    """A row of words as one binary value each."""
    rows = np.ascontiguousarray(near, "<u8")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * len(REACH)), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


SEED = pa.schema([("seed", pa.int64()), ("text_id", pa.int64()), ("needed", pa.int32()), ("theirs", pa.binary())])
HIT = pa.schema([("seed", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("ours", pa.binary())])
LEAK = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_id", pa.int64()), ("n_matched", pa.int64()), ("first_word", pa.int64())])


def benchmark_texts(benchmark: DataFrame) -> DataFrame:
    """(item_id, text_id, n_words, text): items of equal words have one text_id; texts without words are left out."""
    schema = pa.schema([("item_id", pa.int64()), ("text_id", pa.int64()), ("n_words", pa.int32()), ("words", pa.binary())])

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for item_id, text in zip(ids, text_or_empty(batch), strict=True):
                words = b" ".join(words_of(text))
                if words:
                    hashes, _ = hasher.words(np.frombuffer(words, np.uint8))
                    total = mix(np.array([(mix(hashes + np.arange(len(hashes), dtype=np.uint64) * _FACTOR)).sum(dtype=np.uint64)], np.uint64))
                    rows.append((item_id, int(total.view(np.int64)[0]), len(hashes), words))
            if rows:
                yield to_batch(schema, zip(*rows, strict=True))

    shown = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return shown.mapInArrow(tidy(run), "item_id long, text_id long, n_words int, words binary")


def benchmark_seeds(texts: DataFrame) -> DataFrame:
    """(seed, text_id, needed, theirs) of every mask at every place of the distinct texts."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                ids = part.column(0).to_numpy()
                flat, begins, lengths = padded_words([w.as_py() for w in part.column(1)], hasher)
                owner_of = np.repeat(np.arange(len(ids)), lengths + WINDOW)
                limits = np.array([needed(n) for n in lengths.tolist()], np.int32)
                looks = [(mask, places(flat, mask)) for mask in MASKS]
                for n in sorted({n for n in lengths.tolist() if n < WINDOW}):
                    looks += [(mask, begins[lengths == n]) for mask in short_masks(n)]
                for mask, at in looks:
                    if not len(at):
                        continue
                    seeds, owner = seed_hashes(flat, at, mask), owner_of[at - WINDOW]
                    near = flat[at[:, None] + REACH]
                    kept = once(owner, seeds, near)
                    yield pa.RecordBatch.from_arrays([pa.array(seeds[kept]), pa.array(ids[owner[kept]]), pa.array(limits[owner[kept]]), surroundings(near[kept])], schema=SEED)

    return texts.select("text_id", "words").mapInArrow(tidy(run), "seed long, text_id long, needed int, theirs binary")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bit for every seed, as flags: at most ``FILTER_BITS`` bits reach the driver, whatever the benchmark's size."""
    bit = F.pmod("seed", F.lit(FILTER_BITS))
    maps = seeds.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / _BITMAP).alias("part")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(_BITMAP)).cast("int")).alias("bits"))
    found = maps.toArrow()
    flags = np.zeros(FILTER_BITS // 8, np.uint8)
    for part, bits in zip(found.column("part").to_pylist(), found.column("bits").to_pylist(), strict=True):
        at = part * _BITMAP // 8
        flags[at : at + _BITMAP // 8] = np.frombuffer(bits, np.uint8)
    return flags


def document_hits(documents: DataFrame, flags: np.ndarray, masks: list[tuple[int, ...]]) -> DataFrame:
    """(seed, row, doc_id, at, ours) of the documents' seeds that may stand in the benchmark."""
    shared = documents.sparkSession.sparkContext.broadcast(flags)

    def hits(ids: list, rows: np.ndarray, texts: list[bytes], hasher: Hasher):
        flat, begins, lengths = padded_words(texts, hasher)
        owner_of = np.repeat(np.arange(len(texts)), lengths + WINDOW)
        numbers = pa.array(ids, pa.int64())
        for mask in masks:
            at = places(flat, mask)
            seeds = seed_hashes(flat, at, mask)
            bit = seeds % FILTER_BITS
            found = np.flatnonzero(shared.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            for low in range(0, len(found), 1 << 14):
                part = found[low : low + (1 << 14)]
                own = owner_of[at[part] - WINDOW]
                near = flat[at[part][:, None] + REACH]
                kept = once(own, seeds[part], near)
                part, own = part[kept], own[kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seeds[part]), pa.array(rows[own]), numbers.take(pa.array(own)), pa.array((at[part] - begins[own]).astype(np.int64)), surroundings(near[kept])], schema=HIT
                )

    def run(batches):
        from pyspark import TaskContext

        hasher, number = Hasher(), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts, size = [], [], 0
            for k, text in enumerate(text_or_empty(batch)):
                texts.append(plain_words(text))
                ids.append(batch.column(0)[k].as_py())
                size += len(texts[-1])
                if size > BATCH_BYTES or k + 1 == batch.num_rows:
                    yield from hits(ids, np.arange(number, number + len(texts)), texts, hasher)
                    number += len(texts)
                    ids, texts, size = [], [], 0

    shown = documents.select(F.col("doc_id").cast("long"), "text")
    return shown.mapInArrow(tidy(run), "seed long, row long, doc_id long, at long, ours binary")


def verified(met: DataFrame) -> DataFrame:
    """(row, doc_id, text_id, n_matched, first_word) of the hits around which enough words are equal."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(low, 1 << 13)
                ours, theirs = (np.frombuffer(b"".join(part.column(k).to_pylist()), "<u8").reshape(-1, len(REACH)) for k in (0, 1))
                equal = np.cumsum(np.pad((ours == theirs) & (theirs > 0), ((0, 0), (1, 0))), axis=1)
                sums = equal[:, WINDOW:] - equal[:, :-WINDOW]
                best = sums.argmax(axis=1)
                count = sums[np.arange(len(sums)), best]
                kept = np.flatnonzero(count >= part.column(2).to_numpy())
                first = np.maximum(part.column(6).to_numpy() + REACH[0] + best, 0)
                chosen = pa.array(kept)
                yield pa.RecordBatch.from_arrays([part.column(3).take(chosen), part.column(4).take(chosen), part.column(5).take(chosen), pa.array(count[kept].astype(np.int64)), pa.array(first[kept].astype(np.int64))], schema=LEAK)

    return met.select("ours", "theirs", "needed", "row", "doc_id", "text_id", "at").mapInArrow(tidy(run), "row long, doc_id long, text_id long, n_matched long, first_word long")


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it leaks."""
    items = stored(benchmark_texts(benchmark), "benchmark-texts")
    texts = items.groupBy("text_id").agg(F.min("words").alias("words"), F.min("n_words").alias("n_words"))
    seeds = stored(benchmark_seeds(texts), "benchmark-seeds")
    lengths = sorted(r.n_words for r in items.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect())
    masks = [*MASKS, *dict.fromkeys(mask for n in lengths for mask in short_masks(n))]
    met = document_hits(documents, seed_filter(seeds), masks).join(seeds, "seed")
    # the best window of a document and a text, the first of equal ones
    best = verified(met).groupBy("row", "text_id").agg(F.max(F.struct("n_matched", (-F.col("first_word")).alias("back"), "doc_id")).alias("x"))
    found = best.join(items.select("text_id", "item_id"), "text_id")
    return found.select(F.col("x.doc_id").alias("doc_id"), "item_id", F.col("x.n_matched").alias("n_matched"), (-F.col("x.back")).alias("first_word"))


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that leak an item; rows with a null doc_id are compared too."""
    mark = "__leak"
    while mark in documents.columns:
        mark += "_"
    bad = stored(leaks(documents, benchmark).select("doc_id").distinct(), "leaks").withColumnRenamed("doc_id", mark)
    return documents.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(mark)), "left_anti")
