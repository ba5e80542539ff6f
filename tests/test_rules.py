"""Rules and functions against small fixed cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from attestry.functions import rules, text
from attestry.operators.relational import all_token_pairs, as_of, paired_members, token_pairs, union_by_precedence
from attestry.sources import web


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in ((k, {str: "string", int: "long", bool: "boolean", datetime.date: "date", type(None): "date"}[type(v)]) for k, v in values.items())))
    return df.select(column).first()[0]


@pytest.mark.parametrize("raw, expected", [("Bảo Việt  RA MẮT sản phẩm mới!!!", "bảo việt ra mắt sản phẩm mới"), ("Phí tăng 15% — [chính thức]", "phí tăng 15 chính thức"), ("", "")])
def test_normal_title(spark, raw, expected):
    assert one(spark, text.normal_title(F.col("t")), t=raw) == expected


def test_jaccard(spark):
    row = spark.sql("select array('a','b','c') x, array('b','c','d') y, cast(array() as array<string>) z").select(text.jaccard(F.col("x"), F.col("y")), text.jaccard(F.col("x"), F.col("z")), text.jaccard(F.col("x"), F.col("x"))).first()
    assert tuple(row) == (0.5, 0.0, 1.0)


def test_chunks_cover_the_text(spark):
    plan = one(spark, text.chunk_plan(F.col("n")), n=54_921)
    assert [(c["begin"], c["end"]) for c in plan] == [(0, 24_000), (22_800, 46_800), (45_600, 54_921)]
    assert [(c["begin"], c["end"]) for c in one(spark, text.chunk_plan(F.col("n")), n=600)] == [(0, 600)]
    with pytest.raises(ValueError):
        text.chunk_plan(F.col("n"), 100, 100)


D = datetime.date


@pytest.mark.parametrize(
    "published, occurred, effective, expiry, forecast, expected",
    [
        (D(2026, 7, 10), D(2026, 7, 9), None, None, None, "CURRENT_EVENT"),
        (D(2026, 7, 10), D(2024, 5, 1), None, None, None, "NEW_DISCLOSURE_WITH_HISTORICAL_CONTEXT"),
        (D(2026, 7, 20), None, None, None, D(2026, 8, 20), "UPCOMING_ANNOUNCED_EVENT"),
        (D(2026, 7, 15), None, D(2026, 8, 15), None, None, "UPCOMING_ANNOUNCED_EVENT"),
        (D(2026, 7, 15), None, None, D(2026, 8, 10), None, "UPCOMING_ANNOUNCED_EVENT"),
        (None, None, None, None, None, "EXCLUDE"),
        (D(2026, 6, 1), D(2026, 6, 1), None, None, None, "EXCLUDE"),
    ],
)
def test_window_class(spark, published, occurred, effective, expiry, forecast, expected):
    values = dict(published=published, occurred=occurred, effective=effective, expiry=expiry, forecast=forecast)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} date" for k in values))
    assert df.select(rules.window_class("2026-07-01", "2026-07-31", 90)).first()[0] == expected


def test_dates_and_numbers(spark):
    assert one(spark, text.date_literals(F.col("t")), t="2026年7月1日, 01/08/2026, ngày 1 tháng 8 năm 2026, 32/13/2026") == [D(2026, 7, 1), D(2026, 8, 1)]
    read = lambda t: set(one(spark, F.flatten(F.transform(text.number_tokens(F.col("t")), text.canonical_numbers)), t=t))
    assert read("2,0%") & read("2.0%") and read("10.000") & read("10,000")
    assert not read("2%") & read("2") and not read("25.000") & read("52.000")


def test_quotes_fences_and_words(spark):
    assert one(spark, text.quoted_names(F.col("t")), t='“An Tâm” and "Plus" 「福」x') == ["Plus", "An Tâm"]
    assert one(spark, text.without_fence(F.col("t")), t='```json\n{"a":1}\n```') == '{"a":1}'
    assert one(spark, text.has_word(F.col("t"), "bảo việt"), t="của Bảo Việt, nay") is True
    assert one(spark, text.has_word(F.col("t"), "ai"), t="mail") is False


def test_precedence_and_as_of(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in union_by_precedence([a, b], ["k"]).select("k", "v").collect()} == {(1, "a"), (2, "b")}
    at = lambda d, h: datetime.datetime(2026, 1, d, h)
    items = spark.createDataFrame([(1, at(1, 5)), (2, at(1, 7)), (3, at(4, 1)), (4, at(4, 9))], "i int, t timestamp")
    runs = spark.createDataFrame([(10, at(1, 6)), (11, at(2, 1)), (12, at(4, 9))], "r int, s timestamp")
    assert {(r["i"], r["r"]) for r in as_of(items, runs, "t", "s", "r").collect()} == {(1, None), (2, 10), (3, 11), (4, 12)}


def test_token_pairs_equal_brute_force(spark):
    import random

    random.seed(3)
    rows = [(k, random.sample("abcdefghij", random.randint(0, 6))) for k in range(60)]
    found = {(r["a"], r["b"]) for r in token_pairs(spark.createDataFrame(rows, "k int, t array<string>"), "k", "t", 0.6).collect()}
    reps = {}
    for k, t in rows:
        if t:
            reps.setdefault(frozenset(t), k)
    expected = {(min(i, j), max(i, j)) for s, i in reps.items() for u, j in reps.items() if i < j and len(s & u) / len(s | u) >= 0.6}
    assert found == expected


def test_article_falls_back_to_the_body(spark):
    html = "<html><head><title>A &amp; B</title></head><body><nav>menu</nav><article>short</article> tail</body></html>"
    a = one(spark, web.article(F.col("h")), h=html)
    assert (a["title"], a["text"], a["note"]) == ("A & B", "short tail", "BODY")
    assert one(spark, web.pasted_links(F.col("h")), h="x https://a.vn/1). y\nhttps://a.vn/1\nnone") == ["https://a.vn/1"]


def test_every_accent_is_folded(spark):
    """As the canonical decomposition without its marks, and đ; letters of the title are kept."""
    assert one(spark, rules.folded(F.col("h")), h="Ñandú Çà Ö Ä Ü ï ë Đường é Žå ß") == "nandu ca o a u i e duong e za ß"


def test_all_token_pairs_leave_no_copy_out(spark):
    import itertools
    import random

    chance = random.Random(3)
    rows = [(k, chance.sample("abcdefgh", chance.randint(0, 5))) for k in range(80)]
    found = [(r["a"], r["b"], round(r["overlap"], 9)) for r in all_token_pairs(spark.createDataFrame([*rows, rows[5]], "k int, t array<string>"), "k", "t", 0.6).collect()]
    expected = {(i, j, round(len({*s} & {*u}) / len({*s} | {*u}), 9)) for (i, s), (j, u) in itertools.combinations(rows, 2) if s and u and 10 * len({*s} & {*u}) >= 6 * len({*s} | {*u})}
    assert len(found) == len(set(found)) and set(found) == expected and any(o == 1 for *_, o in expected)


def test_large_groups_are_paired_in_chunks(spark):
    members = spark.createDataFrame([(k, 0) for k in range(50)] + [(k, 50) for k in range(50, 70)] + [(70, 70)], "row long, first long")
    met = paired_members(members, spark.createDataFrame([(0, 50, 0.9), (50, 70, 0.8)], "a long, b long, overlap double"), chunk=8)
    found = [tuple(r) for r in met.select("a", "b", "overlap").collect()]
    group = lambda k: 0 if k < 50 else 50 if k < 70 else 70
    expected = {(a, b, {(0, 50): 0.9, (50, 70): 0.8}.get((group(a), group(b)), 1.0)) for a in range(71) for b in range(a + 1, 71) if (group(a), group(b)) != (0, 70)}
    assert len(found) == len(expected) and set(found) == expected
