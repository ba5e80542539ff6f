"""Exact ranks by counts, and the main batch against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from attestry.operators.relational import exact_ranks
from attestry.operators.selection import main_batch


@pytest.mark.parametrize("width", [1, 10, 4096])
def test_ranks_of_a_key_with_all_rows_and_of_small_ones(spark, width):
    chance = random.Random(width)
    rows = [("hot", chance.randint(-50, 9_000)) for _ in range(5_000)] + [("tie", 7)] * 40 + [("one", 3), ("none", None), (None, 5), (None, 6), ("hot", None)]
    found = exact_ranks(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", {"median": F.floor(F.col("n") / 2) + 1, "p90": F.ceil(F.col("n") * 9 / 10), "last": F.col("n"), "beyond": F.col("n") + 1}, width)
    got = {r["k"]: (r["median"], r["p90"], r["last"], r["beyond"]) for r in found.collect()}
    sets = {k: sorted(v for key, v in rows if key == k and v is not None) for k in ("hot", "tie", "one", None)}
    at = lambda s, k: s[k - 1] if 0 < k <= len(s) else None
    assert got == {k: (at(s, len(s) // 2 + 1), at(s, -(-len(s) * 9 // 10)), s[-1], None) for k, s in sets.items()}


def test_no_task_of_a_rank_sees_all_rows(spark):
    """One key holds all rows: what the windows sort are counts of ranges and of one range."""
    rows = spark.range(200_000).select(F.lit("k").alias("k"), F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("v"))
    found = exact_ranks(rows, ["k"], "v", {"median": F.floor(F.col("n") / 2) + 1})
    values = sorted(r["v"] for r in rows.collect())
    assert found.collect()[0]["median"] == values[100_000]


def batch_by_loop(rows, dimensions, shown, floor, per_source, most):
    ranked = sorted(rows, key=lambda r: (-r["score"], r["id"]))
    place = lambda m: next((k for k, d in enumerate(dimensions) if (m.startswith(d[:-1]) if d.endswith("*") else m == d)), None)
    gaps = sorted({(place(m), m) for r in rows for m in r["marks"] if m not in shown and place(m) is not None})
    ordered = []
    for _, mark in gaps:
        best = next(r for r in ranked if mark in r["marks"])
        ordered += [best] * (best not in ordered)
    seeds = len(ordered)
    ordered += [r for r in ranked if r["score"] >= floor and r not in ordered]
    out, used = [], {}
    for k, r in enumerate(ordered):
        if len(out) < most and used.get(r["source"], 0) < per_source:
            used[r["source"]] = used.get(r["source"], 0) + 1
            out.append((r["id"], "SEED" if k < seeds else "PRIORITY", len(out) + 1))
    return out


@pytest.mark.parametrize(("seed", "per_source", "most"), [(1, 2, 100), (2, 1, 5), (3, 50, 8), (4, 3, 12)])
def test_main_batch_equals_a_loop(spark, seed, per_source, most):
    chance = random.Random(seed)
    marks = ["topic:a", "topic:b", "lane:x", "entity:p", "entity:q", "entity:r", "other"]
    rows = [{"id": k, "source": chance.choice("stuv"), "score": chance.choice((10, 40, 60, 80)), "marks": chance.sample(marks, chance.randint(0, 4))} for k in range(60)]
    dimensions, shown = ["topic:b", "topic:a", "lane:x", "entity:*"], {"topic:a", "entity:q"}
    found = main_batch(
        spark.createDataFrame([tuple(r.values()) for r in rows], "id long, source string, score int, marks array<string>"), [F.desc("score"), F.col("id")], dimensions, spark.createDataFrame([(m,) for m in shown], "mark string"), 60, per_source, most
    )
    assert [tuple(r) for r in found.orderBy("pick").collect()] == batch_by_loop(rows, dimensions, shown, 60, per_source, most)
