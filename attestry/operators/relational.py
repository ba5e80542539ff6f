"""Operators on rows: latest row, set precedence, quotas, similarity and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept, scratch
from .banded import set_pairs


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The row of each key that comes last in ``order``: one aggregation with a map-side part."""
    last = F.max(F.struct(*order, *[c for c in values if c not in order])).alias("__last")
    return df.groupBy(*keys).agg(last).select(*keys, *(F.col(f"__last.{v}").alias(v) for v in values))


def first(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    least = F.min(F.struct(*order, *[c for c in values if c not in order])).alias("__first")
    return df.groupBy(*keys).agg(least).select(*keys, *(F.col(f"__first.{v}").alias(v) for v in values))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Rows of each key numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def numbered_by_range(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Rows of each key numbered from 1 in ascending ``order``, however many rows a key has.

    Rows are sorted by range over all tasks and stored; a task numbers its own, and what
    stands before it in a key is added from a table of one row a key and range.
    """
    spark = df.sparkSession
    path = scratch(spark, "ranges")
    df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = numbered(rows, [*keys, "__part"], [F.col(c) for c in order], "__own").join(counts.select(*keys, "__part", before.alias("__before")), [*keys, "__part"])
    return placed.select(*df.columns, (F.col("__own") + F.col("__before")).alias(name))


def union_by_precedence(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which an earlier part's row wins over later ones of its key."""
    tagged = [p.withColumn("__part", F.lit(k)) for k, p in enumerate(parts)]
    together = tagged[0]
    for part in tagged[1:]:
        together = together.unionByName(part)
    values = [c for c in parts[0].columns if c not in keys]
    return first(together, keys, ["__part"], values)


def as_of(left: DataFrame, right: DataFrame, left_time: str, right_time: str, value: str) -> DataFrame:
    """The latest ``value`` of ``right`` at or before each row of ``left``, in one sort.

    Both sides are laid on one time axis and dealt out by day; what a day inherits from the
    days before it is a small table of one row a day, so no task sees the whole history.
    """
    axis = left.withColumns({"__t": F.col(left_time), "__side": F.lit(1), "__v": F.lit(None).cast(right.schema[value].dataType)})
    marks = right.select(F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    both = axis.unionByName(marks, allowMissingColumns=True).withColumn("__day", F.to_date("__t"))
    within = Window.partitionBy("__day").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    ends = marks.groupBy(F.to_date("__t").alias("__day")).agg(F.max_by("__v", "__t").alias("__end"))
    days = both.select("__day").distinct().join(ends, "__day", "left")
    before = days.withColumn("__before", F.last("__end", ignorenulls=True).over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))).select("__day", "__before")
    joined = both.withColumn("__now", F.last("__v", ignorenulls=True).over(within)).where("__side = 1").join(before, "__day")
    return joined.select(*left.columns, F.coalesce("__now", "__before").alias(value))


def exact_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], width: int = 4096) -> DataFrame:
    """The values at given ranks of each key, as columns, by narrowing counts: no key is sorted in one task.

    Rows are counted per value; ranges of ``width`` values tell where a rank lies, and only that
    range is looked through.  ``ranks`` are expressions of ``n``, the rows of the key, counted
    from 1.  Nulls have no rank; values are whole numbers.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("long").alias("__v")).agg(F.count("*").alias("__n"))
    ranges = counts.groupBy(*keys, F.floor(F.col("__v") / width).alias("__r")).agg(F.sum("__n").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__r")
    ranges = ranges.withColumns({"__end": F.sum("__n").over(upto), "n": F.sum("__n").over(Window.partitionBy(*keys))})
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), at.cast("long").alias("at")) for name, at in ranks.items()))
    asked = ranges.withColumn("__x", F.explode(wanted)).where((F.col("__x.at") > F.col("__end") - F.col("__n")) & (F.col("__x.at") <= F.col("__end")))
    asked = asked.select(*keys, "__r", F.col("__x.name").alias("__name"), (F.col("__x.at") - F.col("__end") + F.col("__n")).alias("__at"))
    asked = asked.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = F.floor(F.col("__v") / width) == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    within = counts.join(asked, same)
    within = within.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*keys, "__name").orderBy("__v"))).where(F.col("__upto") >= F.col("__at"))
    return within.groupBy(*keys).agg(*(F.min(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks))


def token_pairs(df: DataFrame, key: str, tokens: str, threshold: float) -> DataFrame:
    """Pairs of rows whose token sets have a Jaccard overlap of ``threshold``, a whole percentage, or more.

    Sets are grouped first, so copies meet once, through a representative; :func:`all_token_pairs`
    gives the pairs of copies, too.
    """
    return set_pairs(df, key, tokens, round(100 * threshold))[1]


def all_token_pairs(df: DataFrame, key: str, tokens: str, threshold: float) -> DataFrame:
    """(a, b, overlap), a < b, of every two rows whose token sets have a Jaccard overlap of ``threshold``, a whole percentage, or more.

    Sets are compared once, however many rows they have; their rows are then paired by
    :func:`paired_members`.
    """
    members, pairs = set_pairs(df, key, tokens, round(100 * threshold))
    return paired_members(members, pairs)


def paired_members(members: DataFrame, pairs: DataFrame, chunk: int = 1 << 10) -> DataFrame:
    """(a, b, overlap), a < b, of all rows of one group, with overlap 1, and of the rows of two groups that are paired.

    ``members``: row, first (the group); ``pairs``: a, b (groups), overlap.  Groups are cut into
    chunks, and every two chunks that must meet are a key of their own, so no group, however
    large, is the work of one task.  Tasks are as many as the rows of the answer ask for.
    """
    spark = members.sparkSession
    sizes = kept(members.groupBy("first").agg(F.count("*").alias("n")), "sizes")
    dealt = members.join(sizes, "first").select("row", "first", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / chunk)).alias("cut"))
    dealt = kept(dealt, "members")
    side = lambda k: sizes.select(F.col("first").alias(k), F.col("n").alias(f"n{k}"))
    own = sizes.where("n > 1").select(F.col("first").alias("a"), F.col("first").alias("b"), F.lit(1.0).alias("overlap"), F.col("n").alias("na"), F.col("n").alias("nb"))
    groups = kept(own.unionByName(pairs.select("a", "b", "overlap").join(side("a"), "a").join(side("b"), "b")), "groups")
    answer = groups.agg(F.sum(F.col("na") * F.col("nb"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), answer // (chunk * chunk))
    cuts = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / chunk) - 1))
    groups = groups.withColumn("i", cuts("na")).withColumn("j", cuts("nb")).where("a <> b or i <= j")
    rows = lambda k, cut, name: dealt.select(F.col("first").alias(k), F.col("cut").alias(cut), F.col("row").alias(name))
    key = ["a", "b", "i", "j"]
    left = groups.select(*key, "overlap").join(rows("a", "i", "x"), ["a", "i"]).repartition(tasks, *key)
    right = groups.select(*key).join(rows("b", "j", "y"), ["b", "j"]).repartition(tasks, *key)
    met = left.join(right, key).where("a <> b or i <> j or x < y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap")


def rank_limited(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each key."""
    return numbered(df, keys, order, "__rank").where(F.col("__rank") <= most).drop("__rank")
