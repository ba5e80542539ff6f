"""Runs of repeating words, found with a dictionary of basic factors.

A run is a stretch of words with smallest period q (words q apart are equal), at least
``EXPONENT`` times as long as q and ``LEAST_WORDS`` words long, that no neighbouring word
extends.  A basic factor is a stretch of 2^k words.  Level k names all factors of that
length: equal factors have equal names, made from the names of their halves.  The next
occurrence of a factor within twice its length, and the one after that, form an arithmetic
progression that proposes its step as a period.  A run of period q is proposed at every
place of the level with 2^(k-1) < q <= 2^k where three occurrences fit, as a factor of at
least q words in a run has no nearer occurrence.  Proposals are extended over all words that
keep the period, and equal ones count once.

A factor that stands once in its text can be no part of a longer one that stands twice, so
each level looks only at what the level before found repeated.  The texts of a batch are
named together in numpy; a text is never split between tasks, and one of n words costs
n log^2 n at most.

Defined cases: a null text, or one of white space, has no words, no runs and the empty text
as collapsed text; rows are judged one by one, so repeated rows and null ids each give a
row; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tidy, to_batch

EXPONENT, LEAST_WORDS = 4, 6
#: Texts are named together until they have so many words.
WORDS_AT_ONCE = 1 << 18

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
FOUND_DDL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, names, next): places of keys found twice or more, in ascending order, a small
    name for each, and the place in this list of its next occurrence, or -1."""
    if not len(keys):
        return (np.empty(0, np.int64),) * 3
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    more = np.concatenate((same, [False])) | np.concatenate(([False], same))
    chain = order[more]  # occurrences of one key stand together, in ascending order
    names = np.cumsum(np.concatenate(([True], ~same))[more])
    after = np.full(len(keys), -1, np.int64)
    after[order[:-1][same]] = order[1:][same]
    places = np.sort(chain)
    slot = np.full(len(keys) + 1, -1, np.int64)
    slot[places] = np.arange(len(places))
    name_at = np.zeros(len(keys), np.int64)
    name_at[chain] = names
    return places, name_at[places], slot[after[places]]


def proposals(words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) that each level's progressions propose.

    ``words`` are ids that differ between texts; ``ends`` is the end of each word's text.
    """
    places, names, following = repeated(words)
    length = 1
    while len(places):
        step = np.where(following >= 0, places[following] - places, 0)
        again = np.where(following >= 0, step[following], 0)
        fits = (step > 0) & (step <= 2 * length) & (again == step)
        if fits.any():
            yield places[fits], step[fits]
        # the factors of twice the length whose halves are both repeated
        name_at = np.zeros(len(words) + 1, np.int64)
        name_at[places] = names
        whole = places + 2 * length <= ends[places]
        firsts, left = places[whole], names[whole]
        right = name_at[firsts + length]
        firsts, left, right = firsts[right > 0], left[right > 0], right[right > 0]
        kept, names, following = repeated(left * (len(words) + 1) + right)
        places = firsts[kept]
        length *= 2


def reach(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, places: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the widest stretch around each place that keeps the period.

    Proposals of one text and period are judged together: the places where words a period
    apart differ, nearest on both sides, bound the stretch.
    """
    starts, stops = np.empty_like(places), np.empty_like(places)
    order = np.lexsort((periods, begins[places]))
    other = (np.diff(periods[order]) != 0) | (np.diff(begins[places[order]]) != 0)
    for group in np.split(order, np.flatnonzero(other) + 1):
        q, low, high = int(periods[group[0]]), int(begins[places[group[0]]]), int(ends[places[group[0]]])
        text = words[low:high]
        bounds = np.concatenate(([-1], np.flatnonzero(text[q:] != text[:-q]), [high - low - q]))
        after = np.searchsorted(bounds, places[group] - low)
        starts[group] = low + bounds[after - 1] + 1
        stops[group] = low + bounds[after] + q
    return starts, stops


def runs_of(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of some texts laid end to end, in order of (start, period)."""
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    begins, ends = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    found = []
    for places, periods in proposals(words, ends):
        # neighbouring places with one step lie in one stretch: its first place speaks for all
        lead = np.concatenate(([True], (np.diff(places) != 1) | (np.diff(periods) != 0)))
        places, periods = places[lead], periods[lead]
        starts, stops = reach(words, begins, ends, places, periods)
        long = stops - starts >= np.maximum(LEAST_WORDS, EXPONENT * periods)
        found.append(np.stack((starts[long], periods[long], stops[long]), 1))
    if not found:
        return (np.empty(0, np.int64),) * 3
    distinct = np.unique(np.concatenate(found), axis=0)
    return distinct[:, 0], distinct[:, 2] - distinct[:, 0], distinct[:, 1]


def judged(ids: list, split: list[list[bytes]]) -> pa.RecordBatch:
    """The rows of some texts that are named together."""
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    known: dict[bytes, int] = {}
    words = np.fromiter((known.setdefault(w, len(known)) for text in split for w in text), np.int64, int(sizes.sum()))
    words += np.repeat(np.arange(len(split)), sizes) * len(known)
    starts, lengths, periods = runs_of(words, sizes)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.searchsorted(bounds, starts, side="right") - 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts + periods, 1)
    np.add.at(edges, starts + lengths, -1)
    dropped = np.cumsum(edges[:-1]) > 0
    collapsed = []
    for text, low, high in zip(split, bounds[:-1], bounds[1:], strict=True):
        own = dropped[low:high]
        kept = [w for w, out in zip(text, own.tolist(), strict=True) if not out] if own.any() else text
        collapsed.append(b" ".join(kept).decode())
    offsets = pa.array(np.searchsorted(owner, np.arange(len(split) + 1)), pa.int32())
    runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(starts - bounds[owner]), pa.array(lengths), pa.array(periods)], fields=list(RUN)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), runs, pa.array(collapsed, pa.string())], schema=FOUND)


def runs(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, ``runs`` in order of (start, period), and the text without repeats.

    ``collapsed`` leaves out the words that stand in a run after its first period; the others
    are joined by one space.
    """

    def find(batches):
        for batch in batches:
            ids, split, count = [], [], 0
            for doc_id, text in zip(batch.column(0), text_or_empty(batch), strict=True):
                ids.append(doc_id.as_py())
                split.append(text.encode("utf-8", "replace").split())  # bytes split at white space of ASCII only
                count += len(split[-1])
                if count >= WORDS_AT_ONCE:
                    yield judged(ids, split)
                    ids, split, count = [], [], 0
            if ids:
                yield judged(ids, split)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(tidy(find), FOUND_DDL)


def planted(documents: DataFrame) -> DataFrame:
    """The query's texts: where crc32 of the decimal id ends in 0, the words repeat from a place on.

    From word a on, word i becomes word a + (i - a) % p.  The words before a, then the block of
    p words as often as it takes, are laid end to end and cut to the number of words.
    """
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    picked = documents.select("doc_id", "text", chosen.alias("chosen"), F.floor(h / 10).alias("g")).withColumn("w", F.when(F.col("chosen"), words))
    n = F.size("w")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    block = F.slice("w", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, (F.floor((n - a) / p) + 1).cast("int"))), F.lit(1), n - a)
    repeating = F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")
    return picked.select("doc_id", F.when(F.col("chosen"), repeating).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row per text: its runs counted, the strongest of them, and digests of both outputs."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    stronger = lambda best, r: F.when(r["length"].cast("decimal(19,0)") * best["period"] > best["length"].cast("decimal(19,0)") * r["period"], r).otherwise(best)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), stronger)  # in order of (start, period), so the first of equals stays
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
