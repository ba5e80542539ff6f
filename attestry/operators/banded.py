"""Links between rows that lie within a band of time and are alike, without all pairs of any group.

Rows are put into classes: one for each value of an exact column, one for each distinct set of
tokens.  Two classes of sets are alike when their Jaccard overlap reaches a percentage; only
classes that stand in the same or in neighbouring buckets of time are compared, after prefix
and positional filters on tokens in the order of their hashes, frequent ones last, and by parities of whole sets.  Only
first tokens and small sets are stored and shuffled; large sets are read again where they meet.

The links are then read off a timeline of each class.  A row meets the row of its class before
it; a row of the smaller of two classes that are alike meets the rows of the larger one nearest
before and after it.  All only within the band.  So n copies give n - 1 links at most, and every
two rows that are alike and within the band are joined through links, as the rows between them
are closer in time still.  A timeline is cut by ranges of rows, not by class: no class, however
large, is the work of one task.

Sets are compared as 64-bit hashes of tokens, classes as 128-bit hashes of their values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..storage import kept

#: Tokens of more classes than this come last in the order; and tokens stored beside twice the lead.
FREQUENT, SLACK = 200, 16
#: A set goes with its first tokens where both numbers multiplied are not more than this; larger sets than this have no parity.
CARRIED, SKETCHED = 256, 1024
#: So many ids are broadcast at most.
SMALL_IDS = 1 << 20
#: Tokens of the sets that are compared in one task, for either side of the pairs; a set counts for so many more.
BLOCK, SET_COST = 1 << 21, 1024


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: Spark would repeat its expression wherever it is used."""
    return df.withColumn(name, F.explode(F.array(value)))


def trigram_sets(df: DataFrame, name: str, words: Column) -> DataFrame:
    """``df`` with the distinct 64-bit numbers of the runs of three words; of the words themselves where there are fewer."""
    numbers = once(df, name, F.transform(words, lambda w: F.xxhash64(w)))
    return once(numbers, name, text.joined_runs(F.col(name)))


def hashed(tokens: Column) -> Column:
    """Tokens as distinct 64-bit numbers."""
    return F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t)))


def class_key(name: str, value: Column) -> Column:
    return F.concat_ws(":", F.lit(name), F.xxhash64(value), F.xxhash64(F.lit(name), value))


def nearest(timeline: DataFrame) -> DataFrame:
    """Rows of (key, at, id, ask) with ``before`` and ``after``: the nearest rows of the key that do not ask, as (at, id).

    Rows are sorted by range over all tasks and stored; what lies beyond a task's own rows comes
    from a table of one row a key and range.
    """
    rows = kept(timeline.repartitionByRange("key", "at", "id", "ask").withColumn("part", F.spark_partition_id()), "timeline")
    here = F.when(~F.col("ask"), F.struct("at", "id"))
    parts = rows.groupBy("key", "part").agg(F.min(here).alias("low"), F.max(here).alias("high"))
    # what follows is sought in the reverse order: Spark goes through a frame that is open at its end anew for every row
    passed = lambda keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own, order = ("key", "part"), ("at", "id", "ask")
    beyond = parts.select("key", "part", F.max("high").over(passed(["key"], ["part"])).alias("earlier"), F.min("low").over(passed(["key"], [F.desc("part")])).alias("later"))
    last = F.last(here, ignorenulls=True)
    seen = rows.withColumns({"before": last.over(passed(own, order)), "after": last.over(passed(own, [F.desc(c) for c in order]))})
    return seen.join(beyond, ["key", "part"]).select("key", "at", "id", "ask", F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after"))


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of some ids; ids are broadcast where their number allows it, so that nothing is shuffled or made of other rows."""
    return rows.join(F.broadcast(ids) if ids.count() <= SMALL_IDS else ids, "id", "left_semi")


def lead(n: Column, percent: int) -> Column:
    """How many tokens of a set of ``n``, in an order that all sets share, can't all be missing in one that is alike."""
    return n - F.ceil(n * percent / 100) + 1


def carried(n: Column, percent: int) -> Column:
    """Whether a set is small enough to go with each of its first tokens."""
    return n * lead(n, percent) <= CARRIED


def kept_lead(n: Column, percent: int) -> Column:
    """How many tokens are stored: the lead, and as many again in case some are too frequent; all of a small set."""
    return F.when(carried(n, percent), n).otherwise(2 * lead(n, percent) + SLACK).cast("int")


def first_tokens(tokens: Column, percent: int) -> Column:
    """The tokens of a set that are stored, in the order of their hashes."""
    return F.slice(F.sort_array(tokens), F.lit(1), F.greatest(F.lit(0), kept_lead(F.size(tokens), percent)))


def parity(tokens: Column) -> Column:
    """Four words of bits that each token turns over: where two of them differ, the sets do.  Null for large sets."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda k: F.aggregate(F.filter(tokens, lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(3)) == k), F.lit(0).cast("long"), lambda x, t: x.bitwiseXOR(bit(t)))
    return F.when(F.size(tokens) <= SKETCHED, F.struct(*(word(k).alias(f"w{k}") for k in range(4))))


def blocked(pairs: DataFrame, rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (p, q, np, nq) with the blocks (bp, bq) of their sets, and each set once for every pair of blocks that asks for it, not for every pair of sets.

    Sets go by the least one that three pairs lead to, so those that are alike share a block; a block that would be too large is cut by ids, and small ones are put together.
    """
    both = kept(pairs.select("p", "q", F.col("np").alias("n")).unionByName(pairs.select(F.col("q").alias("p"), F.col("p").alias("q"), F.col("nq").alias("n"))), "both")
    low = kept(both.groupBy(F.col("p").alias("id")).agg((F.max("n") + SET_COST).alias("cost"), F.least(F.min("q"), F.col("p")).alias("low")), "low")
    for _ in range(2):
        near = both.join(low.select(F.col("id").alias("q"), "low"), "q").groupBy(F.col("p").alias("id")).agg(F.min("low").alias("near"))
        low = kept(low.join(near, "id").select("id", "cost", F.least("low", "near").alias("low")), "low")
    cost = low.groupBy("low").agg(F.sum("cost").alias("cost"))
    few = max(1, (low.agg(F.sum("cost")).first()[0] or 0) // BLOCK)
    alone = F.xxhash64("low", F.pmod(F.xxhash64("id"), F.ceil(F.col("cost") / BLOCK)))
    block = F.when(F.col("cost") > BLOCK, alone).otherwise(F.pmod(F.xxhash64("low"), F.lit(few)))
    placed = kept(low.select("id", "low").join(cost, "low").select("id", block.alias("block")), "blocks")
    side = lambda k: placed.select(F.col("id").alias(k), F.col("block").alias(f"b{k}"))
    dealt = kept(pairs.join(side("p"), "p").join(side("q"), "q").select("bp", "bq", "p", "q", "np", "nq"), "dealt")
    asked = kept(dealt.select("bp", "bq", F.explode(F.array("p", "q")).alias("id")).distinct(), "asked")
    sets = only(rows, placed.select("id")).select("id", F.col(name).alias("w"))
    return dealt, sets.join(F.broadcast(asked) if asked.count() <= SMALL_IDS else asked, "id").select("bp", "bq", "id", "w")


def counted(pairs: DataFrame, rows: DataFrame, name: str, percent: int) -> DataFrame:
    """(p, q, np, nq, common) of the pairs whose sets overlap by ``percent`` or more; a task holds the sets of two blocks."""
    schema = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("np", pa.int32()), ("nq", pa.int32()), ("common", pa.int32())])

    def run(asked: pa.Table, sets: pa.Table) -> pa.Table:
        lists = sets.column("w").combine_chunks()
        ends, codes = lists.offsets.to_numpy(), np.unique(lists.values.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        at = {i: k for k, i in enumerate(sets.column("id").to_pylist())}
        asked = asked.sort_by("p")
        there, last, common = np.zeros(len(codes), bool), None, np.zeros(len(asked), np.int32)
        for k, (p, q) in enumerate(zip(asked.column("p").to_pylist(), asked.column("q").to_pylist(), strict=True)):
            if p != last:
                there[:], last = False, p
                there[codes[ends[at[p]] : ends[at[p] + 1]]] = True
            common[k] = np.count_nonzero(there[codes[ends[at[q]] : ends[at[q] + 1]]])
        n, m = (asked.column(c).to_numpy().astype(np.int64) for c in ("np", "nq"))
        found = asked.select(["p", "q", "np", "nq"]).append_column("common", pa.array(common)).filter(pa.array((100 + percent) * common.astype(np.int64) >= percent * (n + m)))
        return found.cast(schema)

    dealt, sets = blocked(pairs, rows, name)
    return dealt.groupBy("bp", "bq").cogroup(sets.groupBy("bp", "bq")).applyInArrow(run, "p long, q long, np int, nq int, common int")


def near_sets(named: DataFrame, rows: DataFrame, name: str, percent: int, banded: bool = True, reach: tuple[Column, ...] = (), meet: Callable[[str, str], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes (id, c, n) of ``named`` by their first row, and pairs (p, q, overlap), p < q, of those whose sets overlap by ``percent`` or more.

    ``named``, a stored table, has a number ``row`` of its own, id, class c, size n, first tokens w
    and their ``parity`` s, and where banded the bucket; only classes in the same or in
    neighbouring buckets meet.  ``rows`` has the whole sets.  Of ``reach``, aggregates of a class,
    ``meet`` says by the ends of their names whether two classes can be asked for at all.

    Tokens are ordered by their hash, but those of more than ``FREQUENT`` classes come last, the
    most frequent at the end: a class meets others on the first tokens in that order, of which
    only those that two classes have are kept.  Where two meet, sizes, positions and parities
    rule most out, and small sets are compared there and then; of large ones the common first
    tokens must be enough.  Classes whose stored tokens hold too few others have their sets read
    again, and so have large sets that are left.
    """
    few_rows = lambda df: F.broadcast(df) if df.count() <= SMALL_IDS else df
    named = named if banded else named.withColumn("bucket", F.lit(0).cast("long"))
    # a class goes by the number of its first row; rows may be repeated
    first = kept(named.groupBy("c").agg(F.min(F.struct("id", "row")).alias("x"), F.max("n").alias("n"), F.collect_set("bucket").alias("buckets"), *reach), "first")
    extra = [c for c in first.columns if c not in ("c", "x", "n", "buckets")]
    first = first.select("c", "x.id", F.col("x.row").alias("first"), "n", "buckets", *extra)
    later = kept(named.select("row", "c").join(first.select("c", "first"), "c").where("row <> first").select("row"), "later")
    classes = named.join(few_rows(later), "row", "left_anti").select("id", "n", "w", "s")
    frequent = kept(classes.select(F.explode("w").alias("t")).groupBy("t").agg(F.count("*").alias("many")).where(F.col("many") > FREQUENT), "frequent")
    often = few_rows(frequent)
    touched = classes.select("id", "n", F.size("w").alias("size"), F.explode("w").alias("t")).join(often, "t").groupBy("id", "n", "size").agg(F.count("*").alias("often"))
    few = (F.col("size") - F.col("often") < lead(F.col("n"), percent)) & (F.col("size") < F.col("n"))
    touched = kept(touched.select("id", few.alias("short")), "touched")
    short = touched.where("short").select("id")
    # sets without frequent tokens are stored in their order; only others are dealt out to be put into it
    plain = classes.join(few_rows(touched.select("id")), "id", "left_anti").select("id", "n", F.posexplode(F.slice("w", F.lit(1), lead(F.col("n"), percent).cast("int"))).alias("at", "t"))
    whole = only(rows, short).select("id", F.array_distinct(name).alias("w")).dropDuplicates(["id"]).select("id", F.size("w").alias("n"), F.explode("w").alias("t"))
    known = only(classes, touched.where("not short").select("id")).select("id", "n", F.explode("w").alias("t")).unionByName(whole)
    known = known.join(often, "t", "left").select("id", "n", "t", F.coalesce("many", F.lit(0)).alias("last"))
    place = (F.row_number().over(Window.partitionBy("id").orderBy("last", "t")) - 1).alias("at")
    heads = plain.unionByName(known.select("id", "n", place, "t").where(F.col("at") < lead(F.col("n"), percent)))
    heads = kept(heads.withColumn("many", F.count("*").over(Window.partitionBy("t"))).where("many > 1").select("id", "n", (F.col("at") + 1).alias("at"), "t"), "heads")
    # Spark takes an exploded table for as small as the rows that it comes from; the hints keep such sides from being broadcast
    with_set = classes.select("id", "s", F.when(carried(F.col("n"), percent), F.col("w")).alias("w"))
    if banded or extra:
        with_set = with_set.join(first.select("id", *(["buckets"] if banded else []), *extra), "id")
    if banded:
        with_set = with_set.withColumn("bucket", F.explode("buckets"))
    placed = heads.join(with_set.hint("merge"), "id")
    side = lambda k: placed.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("at").alias(f"a{k}"), F.col("s").alias(f"s{k}"), F.col("w").alias(f"w{k}"), *(F.col(c).alias(f"{c}{k}") for c in extra), "t", *(["bucket"] if banded else []))
    both = F.col("np") + F.col("nq")
    enough = lambda common: (100 + percent) * common >= percent * both
    rest = F.least(F.col("np") - F.col("ap"), F.col("nq") - F.col("aq"))
    apart = sum((F.bit_count(F.col(f"sp.w{k}").bitwiseXOR(F.col(f"sq.w{k}"))) for k in range(4)), F.lit(0))
    can = F.coalesce((100 + percent) * apart <= (100 - percent) * both, F.lit(True))
    can = can & meet("p", "q") if meet else can
    small = F.col("wp").isNotNull() & F.col("wq").isNotNull()
    # small sets are compared at the first common token; of others the common first tokens are counted
    can = can & enough(F.when(small, F.lit(1)).otherwise(F.least("ap", "aq")) + rest)
    if banded:
        q = side("q").withColumn("next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("bucket", F.col("bucket") + F.col("next"))
        met = side("p").join(q.hint("merge"), ["t", "bucket"]).where((F.col("p") != F.col("q")) & ((F.col("next") == 1) | (F.col("p") < F.col("q"))) & can)
    else:
        # both sides are one table, which is shuffled once
        met = side("p").join(side("q").hint("merge"), "t").where((F.col("p") < F.col("q")) & can)
    met = met.withColumn("common", F.when(small, F.size(F.array_intersect("wp", "wq")))).where(F.col("common").isNull() | enough(F.col("common")))
    turned = F.col("p") > F.col("q")
    turn = lambda k, m: F.when(turned, F.col(m)).otherwise(F.col(k)).alias(k)
    met = met.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), turn("np", "nq"), turn("nq", "np"), turn("ap", "aq"), turn("aq", "ap"), "common")
    met = met.groupBy("p", "q", "np", "nq").agg(F.max("common").alias("common"), F.count("*").alias("shared"), F.max("ap").alias("ap"), F.max("aq").alias("aq"))
    # what is common beyond the counted ones lies behind the last of them, and behind the first tokens of one of the two
    beyond = F.least(rest, F.greatest(F.col("np") - lead(F.col("np"), percent), F.col("nq") - lead(F.col("nq"), percent)))
    met = kept(met.where(F.col("common").isNotNull() | enough(F.col("shared") + beyond)).select("p", "q", "np", "nq", "common"), "met")
    read = kept(counted(met.where("common is null").drop("common"), rows, name, percent), "read")
    found = met.where("common is not null").unionByName(read).select("p", "q", (F.col("common") / (both - F.col("common"))).alias("overlap"))
    return first.select("id", "c", "n"), found


def alike(base: DataFrame, rows: DataFrame, name: str, percent: int) -> DataFrame:
    """(p, q, overlap) of unlike classes whose sets overlap by ``percent`` or more and that stand in neighbouring buckets.

    ``base`` has id, bucket, and of each set its class ``k_``, size ``n_``, first tokens ``t_``
    and parity ``s_``; ``rows`` has the whole sets.
    """
    named = base.where(F.col(f"k_{name}").isNotNull()).select("row", "id", F.col(f"k_{name}").alias("c"), "bucket", F.col(f"n_{name}").alias("n"), F.col(f"t_{name}").alias("w"), F.col(f"s_{name}").alias("s"))
    classes, found = near_sets(named, rows, name, percent)
    key = lambda k: classes.select(F.col("id").alias(k), F.col("c").alias(f"c{k}"))
    return found.join(key("p"), "p").join(key("q"), "q").select(F.least("cp", "cq").alias("p"), F.greatest("cp", "cq").alias("q"), "overlap").distinct()


def set_pairs(df: DataFrame, key: str, tokens: str, percent: int, beside: tuple[str, ...] = (), reach: tuple[Column, ...] = (), meet: Callable[[str, str], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, first) of all rows with tokens, and pairs (a, b, overlap), a < b, of first rows whose sets overlap by ``percent`` or more.

    Exact up to hashes: tokens count as 64-bit numbers, sets as 128-bit ones, and rows of equal
    sets stand for each other through the first of them.  ``reach`` and ``meet`` are those of
    :func:`near_sets`, over the columns ``beside``.
    """
    w = F.col(tokens) if dict(df.dtypes)[tokens] == "array<bigint>" else hashed(F.col(tokens))
    rows = once(df.select(F.col(key).alias("id"), *beside, tokens), "w", F.array_distinct(w)).select("id", *beside, "w").where(F.size("w") > 0)
    named = rows.select("id", *beside, class_key("w", F.sort_array("w")).alias("c"), F.size("w").alias("n"), first_tokens(F.col("w"), percent).alias("w"), parity(F.col("w")).alias("s"))
    named = kept(named.withColumn("row", F.monotonically_increasing_id()), "named")
    classes, found = near_sets(named, rows, "w", percent, False, reach, meet)
    members = named.select("id", "c").distinct().join(classes.select("c", F.col("id").alias("first")), "c").select(F.col("id").alias("row"), "first")
    return members, found.select(F.col("p").alias("a"), F.col("q").alias("b"), "overlap")


def banded_links(rows: DataFrame, band: int, exact: list[str], sets: dict[str, int], beside: tuple[str, ...] = ()) -> DataFrame:
    """(a, b) of linked rows, a < b, and their overlap in every set: 1 for equal sets, null under the percentage.

    Also whether they are equal in each exact column, as ``same_`` and its name, and the columns
    ``beside`` of both, as ``a_`` and ``b_`` and the name.

    ``rows``: id, at (seconds) and the named columns; ``exact`` hold values that link where
    equal, ``sets`` hold arrays of 64-bit tokens, each with its percentage.

    Defined cases: a null value or an empty set links nothing, and a row without a time nothing
    either; repeated rows of one id are one.
    """
    keys = {name: F.when(F.col(name).isNotNull(), class_key(name, F.col(name))) for name in exact}
    keys |= {name: F.when(F.size(name) > 0, class_key(name, F.sort_array(name))) for name in sets}
    rows = rows.where("at is not null and id is not null")
    size = {name: F.size(name) for name in sets}
    first = {name: first_tokens(F.col(name), percent) for name, percent in sets.items()}
    base = rows.select("id", F.col("at").cast("long").alias("at"), F.floor(F.col("at") / band).alias("bucket"), *beside, *(k.alias(f"k_{name}") for name, k in keys.items()), *(size[name].alias(f"n_{name}") for name in sets), *(first[name].alias(f"t_{name}") for name in sets), *(parity(F.col(name)).alias(f"s_{name}") for name in sets))
    base = kept(base.withColumn("row", F.monotonically_increasing_id()), "rows")
    near = {name: kept(alike(base, rows, name, percent), f"alike-{name}") for name, percent in sets.items()}
    members = base.select("at", "id", F.explode(F.array_compact(F.array(*(f"k_{name}" for name in keys)))).alias("key")).distinct()
    timeline = members.select("key", "at", "id", F.lit(False).alias("ask"))
    if near:
        sizes = members.groupBy("key").agg(F.count("*").alias("many"), F.min("id").alias("first"))
        side = lambda k: sizes.select(F.col("key").alias(k), F.struct("many", (-F.col("first")).alias("late")).alias(f"s{k}"))
        pairs = reduce(DataFrame.unionByName, (found.select("p", "q") for found in near.values())).join(side("p"), "p").join(side("q"), "q")
        small = F.col("sp") < F.col("sq")
        asked = pairs.select(F.when(small, F.col("q")).otherwise(F.col("p")).alias("large"), F.when(small, F.col("p")).otherwise(F.col("q")).alias("key"))
        timeline = timeline.unionByName(asked.join(members, "key").select(F.col("large").alias("key"), "at", "id", F.lit(True).alias("ask")))
    ends = F.array_compact(F.array("before", F.when(F.col("ask"), F.col("after"))))
    met = nearest(timeline).select("id", "at", F.explode(ends).alias("x")).where((F.abs(F.col("at") - F.col("x.at")) <= band) & (F.col("id") != F.col("x.id")))
    links = met.select(F.least("id", "x.id").alias("a"), F.greatest("id", "x.id").alias("b")).distinct()
    side = lambda k: base.select(F.col("id").alias(k), *(F.col(f"k_{name}").alias(f"{k}_k_{name}") for name in keys), *(F.col(name).alias(f"{k}_{name}") for name in beside)).distinct()
    out = links.join(side("a"), "a").join(side("b"), "b")
    for name, found in near.items():
        both = found.select("p", "q", F.col("overlap").alias("o"))
        out = out.withColumns({"p": F.least(f"a_k_{name}", f"b_k_{name}"), "q": F.greatest(f"a_k_{name}", f"b_k_{name}")}).join(both, ["p", "q"], "left")
        out = out.withColumn(name, F.when(F.col(f"a_k_{name}") == F.col(f"b_k_{name}"), 1.0).otherwise(F.col("o"))).drop("p", "q", "o")
    same = (F.coalesce(F.col(f"a_k_{name}") == F.col(f"b_k_{name}"), F.lit(False)).alias(f"same_{name}") for name in exact)
    return out.select("a", "b", *sets, *same, *(f"{k}_{name}" for name in beside for k in "ab"))
