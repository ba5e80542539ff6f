"""Greedy selections whose next pick depends on the picks before it.

The greedy part is sequential by definition, so it runs over a set whose size is bounded by
the quotas: rows that no order of picks can reach are left out first, by ranks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept, scratch
from .relational import rank_limited

#: Components of more rows than this are grouped alone, smaller ones together up to about as many; members of near classes held at once.
PACK, HELD = 1 << 14, 1 << 21


def greedy(rows: list[dict], phases: list[tuple[str | None, int]], budget: int, per_source: int) -> list[dict]:
    """Picks in order: each phase takes rows of its mark until it has its number, a source gives
    ``per_source`` at most; what is left of the budget is filled without that limit."""
    picked, chosen, used = [], set(), {}

    def take(row: dict) -> None:
        picked.append(row)
        chosen.add(row["id"])

    for mark, wanted in phases:
        fits = lambda row: mark is None or mark in row["marks"]  # noqa: B023, E731
        have = sum(map(fits, picked))
        for row in rows:
            if len(picked) >= budget or have >= wanted:
                break
            if row["id"] in chosen or not fits(row) or used.get(row["source"], 0) >= per_source:
                continue
            take(row)
            used[row["source"]] = used.get(row["source"], 0) + 1
            have += 1
    for row in rows:
        if len(picked) >= budget:
            break
        if row["id"] not in chosen:
            take(row)
    return picked


def reachable(candidates: DataFrame, order: list[Column], budget: int, per_source: int) -> DataFrame:
    """The candidates that :func:`greedy` can pick at all.

    Of a mark and a source only the first ``per_source`` rows can be picked in a phase: those
    before a picked row were picked too.  Of these, a phase passes at most ``budget`` that are
    picked and as many whose source is used up.  The last filling takes from the first
    ``budget`` rows that are not picked yet, so from the first two budgets of all.
    """
    marked = candidates.select("*", F.explode(F.array_append("marks", F.lit("*"))).alias("__mark"))
    near = rank_limited(marked, ["__mark", "source"], order, per_source)
    wanted = rank_limited(near, ["__mark"], order, 2 * budget).select("id").unionByName(candidates.orderBy(*order).limit(2 * budget).select("id")).distinct()
    return candidates.join(wanted, "id", "left_semi")


def select_under_quotas(candidates: DataFrame, order: list[Column], phases: list[tuple[str | None, int]], budget: int, per_source: int) -> DataFrame:
    """(id, pick) of the rows that are picked, in order.  Candidates: id, source, marks, and what ``order`` reads."""
    schema = pa.schema([("id", pa.int64()), ("pick", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        picked = greedy([{"id": r["id"], "source": r["source"], "marks": set(r["marks"])} for r in rows], phases, budget, per_source)
        return pa.table([[r["id"] for r in picked], list(range(1, len(picked) + 1))], schema=schema)

    small = reachable(candidates, order, budget, per_source)
    placed = small.select("id", "source", "marks", F.row_number().over(Window.orderBy(*order)).alias("place"))
    return placed.groupBy().applyInArrow(run, "id long, pick long")


def main_batch(candidates: DataFrame, order: list[Column], dimensions: list[str], represented: DataFrame, floor: int, per_source: int, most: int) -> DataFrame:
    """(id, why, pick): first the best candidate of every dimension that nothing represents yet, then all of high score.

    Candidates: id, source, score, marks, and what ``order`` reads; ``dimensions`` are marks, in
    the order in which gaps are filled, those that end with ``*`` stand for all marks with that
    beginning, by name; ``represented`` has the marks that need no seed.  A source gives
    ``per_source`` candidates at most, and ``most`` is the ceiling of the batch.
    """
    place = F.lit(None).cast("int")
    for k, mark in enumerate(dimensions):
        fits = F.startswith("mark", F.lit(mark[:-1])) if mark.endswith("*") else F.col("mark") == mark
        place = F.coalesce(place, F.when(fits, F.lit(k)))
    marked = candidates.withColumn("mark", F.explode("marks")).join(represented.select("mark").distinct(), "mark", "left_anti").withColumn("place", place).where("place is not null")
    seeds = rank_limited(marked, ["mark"], order, 1).groupBy("id").agg(F.min(F.struct("place", "mark")).alias("gap"))
    chosen = candidates.join(seeds, "id", "left").where((F.col("gap").isNotNull()) | (F.col("score") >= floor))
    first = [F.col("gap").isNull(), F.col("gap"), *order]
    capped = rank_limited(chosen, ["source"], first, per_source).orderBy(*first).limit(most)
    return capped.select("id", F.when(F.col("gap").isNotNull(), "SEED").otherwise("PRIORITY").alias("why"), F.row_number().over(Window.orderBy(*first)).alias("pick"))


def connected(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) of the nodes of (a, b): the smallest id that links reach.  Each round is stored."""
    spark = edges.sparkSession

    def stored(df: DataFrame) -> DataFrame:
        path = scratch(spark, "connected")
        df.write.parquet(path)
        return spark.read.parquet(path)

    both = stored(edges.select("a", "b").unionAll(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")))
    for _ in range(rounds):
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(around, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = least.select(F.col("id").alias("label"), F.col("label").alias("further"))
        after = stored(least.join(jump, "label").select("id", F.least("label", "further").alias("label"), "was"))
        if after.where("label <> was").isEmpty():
            return after.select("id", F.col("label").alias("component"))
        labels = after.select("id", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_classes(a: np.ndarray, b: np.ndarray) -> Callable[[int | None], set[int]]:
    """What is near to a class, itself included, by links (a, b); no class is near to none."""
    ends, order = np.concatenate([a, b]), np.argsort(np.concatenate([a, b]), kind="stable")
    ends, others = ends[order], np.concatenate([b, a])[order]
    held: dict[int, set[int]] = {}
    room = HELD

    def of(x: int | None) -> set[int]:
        nonlocal room
        if x is None:
            return set()
        if x not in held:
            found = {x, *others[np.searchsorted(ends, x) : np.searchsorted(ends, x, "right")].tolist()}
            if room < len(found):
                held.clear()
                room = HELD
            held[x] = found
            room -= len(found)
        return held[x]

    return of


def first_fits(kinds: Iterable[tuple], near_title: Callable, near_text: Callable, days: int) -> list[tuple[int, int]]:
    """(kind, story): each kind (id, day, market, title class, text class) joins the first story in which it is like every member.

    A story is known by its range of days, its market and the classes of its members.
    """
    stories: list[list] = []
    by_title: dict[int, list[int]] = {}
    by_text: dict[int, list[int]] = {}
    out = []
    for kind, day, market, title, said in kinds:
        titles, texts = near_title(title), near_text(said)
        # the first member must be like it, too
        asked = {k for t in titles & by_title.keys() for k in by_title[t]} | {k for t in texts & by_text.keys() for k in by_text[t]}
        for k in sorted(asked):
            first, low, high, where, members = stories[k]
            if not (high - days <= day <= low + days) or (market is not None and where is not None and market != where):
                continue
            if members.keys() <= titles or all(t in titles or said_there <= texts for t, said_there in members.items()):
                stories[k][1:4] = min(low, day), max(high, day), where if market is None else market
                break
        else:
            first, members, k = kind, {}, len(stories)
            stories.append([kind, day, day, market, members])
            by_title.setdefault(title, []).append(k)
            by_text.setdefault(said, []).append(k)
        members.setdefault(title, set()).add(said)
        out.append((kind, first))
    return out


def stories_of(rows: DataFrame, links: DataFrame, days: int) -> DataFrame:
    """(id, story): complete-link groups of rows, named by their first member.

    ``rows``: id, place (its order), day (a number), market, and the classes of its title and of
    its text, each named by its first row.  Two rows are of one story when their days lie within
    ``days``, their markets are equal or one is null, and their titles or their texts are of one
    class or of two that are linked.  ``links``: title (else text), a, b.

    Rows of one kind, equal in all but id and place, join the story of the first of them: what
    it is like they are like, so stories before that one refuse them, too.  So only the first
    ones are grouped.  Only kinds of one component of classes and links can share a story, so
    components are grouped apart, small ones some together.
    """
    lone = F.when(F.col("t").isNull() & F.col("g").isNull(), F.col("id"))
    kind = F.min(F.struct("place", "id")).over(Window.partitionBy("t", "g", "day", "market", lone)).getField("id")
    rows = kept(rows.select("id", "place", "day", "market", "t", "g").distinct().withColumn("kind", kind), "kinds")
    kinds = rows.where("id = kind").drop("kind")
    edges = kinds.select(F.explode(F.array("t", "g")).alias("a"), F.col("id").alias("b")).where("a <> b").unionByName(links.select("a", "b"))
    component = connected(edges)
    sizes = component.groupBy("component").agg(F.count("*").alias("n"))
    packs = max(1, (sizes.where(F.col("n") <= PACK).agg(F.sum("n")).first()[0] or 0) // PACK)
    part = F.when(F.col("n") > PACK, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(packs)))
    parts = kept(component.join(sizes, "component").select("id", part.alias("part")), "parts")
    schema = pa.schema([("kind", pa.int64()), ("story", pa.int64())])

    def run(nodes: pa.Table, lines: pa.Table) -> pa.Table:
        ordered = nodes.sort_by("place").select(["id", "day", "market", "t", "g"])
        near = [near_classes(*(lines.filter(pc.equal(lines["title"], title))[c].to_numpy() for c in "ab")) for title in (True, False)]
        found = first_fits(zip(*(c.to_pylist() for c in ordered.columns), strict=True), *near, days)
        return pa.table([[k for k, _ in found], [s for _, s in found]], schema=schema)

    nodes = kinds.join(parts, "id").select("part", "id", "place", "day", "market", "t", "g")
    lines = links.join(parts.select(F.col("id").alias("a"), F.col("part").alias("beside")), "a").select("beside", "title", "a", "b")
    grouped = nodes.groupBy("part").cogroup(lines.groupBy("beside")).applyInArrow(run, "kind long, story long")
    return rows.join(grouped, "kind", "left").select("id", F.coalesce("story", "kind").alias("story"))


def story_groups(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, story): complete-link groups of candidates (id, place) by pairs (a, b) of them, named by their first member."""
    rows = candidates.select("id", "place", F.lit(0).alias("day"), F.lit(None).cast("string").alias("market"), F.col("id").alias("t"), F.lit(None).cast("long").alias("g"))
    return stories_of(rows, pairs.select(F.lit(True).alias("title"), "a", "b"), 0)


Rule = Callable[[DataFrame], Column]
