"""The dictionary join against a pattern per alias, on both of its ways."""

import random
import re

import pytest
from pyspark.sql import functions as F

from attestry.bindings import ALIASES
from attestry.functions import intelligence
from attestry.operators import dictionary

SIGNS = ["aia", "AIA", "group", "việt", "Nam", "co.", "ltd", "ltd.", "nyse", "nyse:", "pru", ", ", " ", " ", " ", ":", "(", ")", ".", "1299", "²", "é", "\n", "-", "\x02", "\x04", "日本", "İ", "á"]


def stands(alias, text):
    """Whether the signs of an alias stand in a text between signs that are no letters or digits."""
    kind = lambda c: c.isalpha() or c.isnumeric()
    text, alias = text.lower(), alias.lower()
    at = text.find(alias)
    while at >= 0:
        end = at + len(alias)
        if not (at and kind(text[at - 1])) and not (end < len(text) and kind(text[end])):
            return True
        at = text.find(alias, at + 1)
    return False


@pytest.mark.parametrize("small_rows", [1 << 17, 0])
def test_hits_equal_a_search_for_every_alias(spark, small_rows):
    chance = random.Random(8)
    made = lambda most: "".join(chance.choice(SIGNS) for _ in range(chance.randint(1, most)))
    texts = [(k, made(14)) for k in range(400)] + [(400, None), (401, ""), (402, "aia"), (402, "aia")]
    aliases = sorted({a for a in (made(4) for _ in range(300)) if any(c.isalnum() for c in a) and not set(a) & set("\x02\x04")})
    found = dictionary.found(
        spark.createDataFrame(texts, "id int, text string"), "text", spark.createDataFrame([(a, k) for k, a in enumerate(aliases)] + [(None, -1), ("--", -2)], "alias string, n int"), "alias", small_rows=small_rows
    )
    assert found.columns == ["id", "text", "alias", "n"]
    expected = sorted((k, a) for k, t in texts if t for a in aliases if stands(a, t))
    assert sorted((r["id"], r["alias"]) for r in found.collect()) == expected and len(expected) > 300


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_plan_has_no_pattern_per_alias_and_does_not_grow(spark):
    texts = spark.createDataFrame([(1, "x", "VN")], "id int, text string, market string")
    plan = plan_of(intelligence.resolved(texts, intelligence.entity_aliases(spark)))
    assert "RLIKE" not in plan and len(re.findall("manulife", plan, re.IGNORECASE)) == 0


def test_a_hundred_thousand_aliases(spark):
    aliases = spark.range(100_000).select(F.concat(F.lit("firm "), F.col("id"), F.lit(" co., ltd.")).alias("alias"), "id")
    texts = spark.range(3_000).select(F.col("id").alias("k"), F.concat(F.lit("Shares of FIRM "), F.col("id") * 37, F.lit(" Co., Ltd. and firm "), F.col("id"), F.lit(" co., ltd.x rose")).alias("text"))
    for small in (1 << 17, 1):
        found = dictionary.found(texts, "text", aliases, "alias", small_rows=small)
        rows = found.select("k", "id").collect()
        assert sorted((r["k"], r["id"]) for r in rows) == [(k, 37 * k) for k in range(2_703)]


def test_resolution_by_join_equals_one_pattern_an_alias(spark):
    chance = random.Random(4)
    words = [*ALIASES, *("and", "the bank", "x" * 3, "aiax", "1aia", "(aia)", "prudential.", "")]
    texts = [(k, " ".join(chance.choice(words) for _ in range(chance.randint(0, 4))), chance.choice(("VN", "vn ", "GLOBAL", None, "US", ""))) for k in range(500)] + [(900, None, "VN"), (1, "aia", "VN"), (1, "aia", "VN")]
    rows = spark.createDataFrame(texts, "id int, text string, market string")
    joined = intelligence.resolved(rows, intelligence.entity_aliases(spark)).collect()
    plain = rows.withColumn("resolution", intelligence.resolution(F.col("text"), F.col("market"))).collect()
    assert sorted(map(str, joined)) == sorted(map(str, plain)) and len({r["resolution"]["status"] for r in joined}) == 5
