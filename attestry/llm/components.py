"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, to_batch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    pairs = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return pairs.where("u <> v").distinct()


#: Edge tables of at most so many rows are joined up by one task; larger ones by rounds of stars.
ONE_TASK_EDGES = 1 << 18


def _in_one_task(edges: DataFrame) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("component", pa.int64())])

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                parent[max(a, b)] = min(a, b)
        yield to_batch(schema, (list(parent), [root(x) for x in list(parent)]))

    return edges.repartition(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, rounds: int = 60, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component) of every node of an edge, named by the smallest node.

    ``edges`` has two columns of 64-bit integers.  Each round is written to the shared
    folder, so a lost executor costs a round and plans stay short.
    """
    first, second = edges.columns[:2]
    now = edges.select(F.col(first).alias("u"), F.col(second).alias("v")).where("u <> v").distinct()
    now, before = stored(now, "edges"), None
    if now.count() <= one_task_edges:
        return _in_one_task(now)
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = stored(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
