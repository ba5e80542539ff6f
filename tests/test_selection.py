"""Greedy selections, story groups, parsers and repairs against plain loops and fixed cases."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from attestry import bindings
from attestry.functions import grounding, intelligence, repair, text
from attestry.operators import relational, selection
from attestry.plans import dedup, events, rules
from attestry.plans import selection as selections
from attestry.sources import web


def test_pruned_selection_equals_the_greedy_loop_over_all_rows(spark):
    chance = random.Random(5)
    rows = []
    for k in range(1500):
        marks = sorted({f"topic:{chance.choice('abc')}", f"lane:{chance.choice('xyz')}", *(["market:VN"] if chance.random() < 0.1 else [])})
        rows.append((k, f"s{chance.choice([0, 0, 0, *range(40)])}", chance.randint(0, 50), marks))
    phases = [("topic:a", 3), ("topic:c", 3), ("lane:y", 5), ("market:VN", 8), (None, 24)]
    ordered = sorted(rows, key=lambda r: (-r[2], r[1], r[0]))
    for budget, per_source in ((24, 2), (60, 1), (24, 50)):
        expected = selection.greedy([{"id": i, "source": s, "marks": set(m)} for i, s, _, m in ordered], phases, budget, per_source)
        df = spark.createDataFrame(rows, "id long, source string, score int, marks array<string>")
        found = selection.select_under_quotas(df, [F.desc("score"), F.col("source"), F.col("id")], phases, budget, per_source).orderBy("pick").collect()
        assert [r["id"] for r in found] == [r["id"] for r in expected]
        reach = selection.reachable(df, [F.desc("score"), F.col("source"), F.col("id")], budget, per_source)
        assert reach.count() < len(rows) or per_source == 50


def test_stories_are_complete_links_and_no_chains(spark):
    pairs = [(1, 2), (2, 3), (4, 5), (5, 6), (4, 6), (7, 8)]
    nodes = spark.createDataFrame([(k, k) for k in range(1, 11)], "id long, place long")
    found = {r["id"]: r["story"] for r in selection.story_groups(nodes, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 7, 9: 9, 10: 10}
    chain = spark.createDataFrame([(k, k + 1) for k in range(100)], "a long, b long")
    assert {r["component"] for r in selection.connected(chain).collect()} == {0}


def test_numbers_by_range_equal_a_window(spark):
    df = spark.createDataFrame([(k % 3, (k * 37) % 1000) for k in range(1000)], "key long, x long").repartition(5)
    found = sorted((r["key"], r["x"], r["rank"]) for r in relational.numbered_by_range(df, ["key"], ["x"]).collect())
    plain = sorted((r["key"], r["x"], r["rank"]) for r in relational.numbered(df, ["key"], [F.col("x")]).collect())
    assert found == plain


def documents_at(spark, monkeypatch, hours, module):
    start = datetime.datetime(2026, 6, 1)
    rows = [(k, "src1", "u", "same", start + datetime.timedelta(hours=h), None) for k, h in enumerate(hours)]
    shape = "id long, source_code string, url string, content_hash string, published_at timestamp, fetched_at timestamp"
    monkeypatch.setattr(module, "documents", lambda s, d: s.createDataFrame(rows, shape))
    monkeypatch.setattr(module, "sources", lambda s, d: s.createDataFrame([("src1", 50)], "code string, authority_score int"))


@pytest.mark.parametrize(("hours", "expected"), [([0, 71, 73], [(0, 1), (1, 2)]), ([1, 71, 80], [(0, 1), (1, 2)]), ([0, 80, 200], []), ([0, 72, 73], [(0, 1), (1, 2)])])
def test_every_copy_within_72_hours_is_linked(spark, monkeypatch, hours, expected):
    documents_at(spark, monkeypatch, hours, dedup)
    assert sorted((r["a"], r["b"]) for r in dedup.banded_pairs(spark, "").collect()) == expected


CASES = (  # claim, evidence, outcome
    ("Growth was 2,0% on 2026-07-01", "tăng 2.0% kể từ ngày 1 tháng 7 năm 2026", "PASS"), ("Paid 10.000 in 2026", "tổng 10,000 tại 2026", "PASS"),
    ("Now 25.000", "52.000 vào 01/08/2026", "FAIL_NUMBER_NOT_IN_EVIDENCE"), ("Rate 2%", "2 khách hàng", "FAIL_NUMBER_NOT_IN_EVIDENCE"), ("On 2026年7月1日 “An Tâm” began", "01/07/2026 “An Tâm” ra mắt", "PASS"),
    ("On 32/13/2026", "31/12/2026", "PASS"), ("“This procedure” and “An Tâm”", "thủ tục", "FAIL_NAME_NOT_IN_EVIDENCE"), ("“thủ tục này” holds", "x", "PASS"), ("On 2026-07-02", "2026-07-01", "FAIL_DATE_NOT_IN_EVIDENCE"),
)


def test_grounding_gate_on_fixed_cases(spark):
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(CASES)], "k int, claim string, evidence string, expected string")
    status = grounding.gate(F.col("claim"), F.col("evidence"), F.array(F.lit("F-1")), F.array(F.lit("F-1")))
    assert [(r["k"], r["s"]) for r in df.select("k", status.alias("s"), "expected").where("s <> expected").collect()] == []
    none = df.select(grounding.gate(F.col("claim"), F.col("evidence"), F.array().cast("array<string>"), F.array(F.lit("F-1"))).alias("s")).distinct().collect()
    assert [r["s"] for r in none] == ["FAIL_NO_CITATION"]


def test_dates_in_five_spellings(spark):
    said = "2026-7-5, 3.7.2026, ngày 4 tháng 7 năm 2026, the 1st Sept 2026 and June 2nd, 2026; not 31 February 2026"
    row = spark.range(1).select(grounding.wide_dates(F.lit(said)).alias("d")).first()
    assert [str(d) for d in row["d"]] == ["2026-06-02", "2026-07-03", "2026-07-04", "2026-07-05", "2026-09-01"]


def test_kinds_of_events_and_entities(spark):
    kinds = [("insurer launched a new rider", "PRODUCT_LAUNCH"), ("voucher campaign", "MARKETING_PROMOTION"), ("lawful allowances", "OTHER"), ("new self-service claims service", "SERVICE_EXPERIENCE_CHANGE"), ("premium will decrease", "PRICING_CHANGE"), ("quyền lợi tăng", "BENEFIT_CHANGE")]
    df = spark.createDataFrame([(k, t, e) for k, (t, e) in enumerate(kinds)], "k int, t string, e string")
    assert df.where(intelligence.event_type(F.col("t"), F.lit("OTHER")) != F.col("e")).count() == 0
    named = [("Prudential Vietnam grows", "VN", "RESOLVED", "PRUDENTIAL_VN"), ("Prudential grows", "VN", "RESOLVED", "PRUDENTIAL_VN"), ("Prudential grows", "GLOBAL", "AMBIGUOUS", "PRUDENTIAL_PLC,PRUDENTIAL_VN"), ("PGIM and Prudential plc", "US", "CONFLICT", "PRUDENTIAL_FINANCIAL_US,PRUDENTIAL_PLC"),
             ("AIA Vietnam and MB Life", None, "MULTIPLE", "AIA_VN,MB_AGEAS_VN"), ("Asia", "VN", "UNRESOLVED", ""), ("", "VN", "UNRESOLVED", "")]
    df = spark.createDataFrame(named, "t string, m string, s string, e string").withColumn("r", intelligence.resolution(F.col("t"), F.col("m")))
    assert [(r["t"], r["r"]) for r in df.where("r.status <> s or r.entities <> e").collect()] == []


def test_materiality_of_fixed_statements(spark):
    base = {"headline": "Insurer launched a new rider", "span": "The insurer launched a rider with wider coverage and a benefit of 12% for families in the north of the country.", "fact_type": "PRODUCT_LAUNCH", "labels": ["PRODUCT_LAUNCH"], "status": "CONFIRMED", "company": "A", "product": "B",
            "published": datetime.date(2026, 8, 1), "full_text": True, "parse_status": "OK", "duplicate": False, "authority": "REGULATOR", "text_chars": 900}
    cases = [base, {**base, "duplicate": True}, {**base, "headline": "Bank raises deposit rates", "span": "x" * 90}, {**base, "authority": "SOCIAL_OR_BLOG"}, {**base, "full_text": False}, {**base, "published": None}]
    shape = "headline string, span string, fact_type string, labels array<string>, status string, company string, product string, published date, full_text boolean, parse_status string, duplicate boolean, authority string, text_chars int"
    rows = intelligence.materiality(spark.createDataFrame([tuple(c.values()) for c in cases], shape), "2026-08-06").collect()
    first = rows[0]
    assert (first["relevance"], first["impact"], first["timeliness"], first["evidence"], first["penalty"], first["total"], first["eligible"]) == (29, 24, 15, 19, 0, 87, True)
    assert [r["eligible"] for r in rows] == [True, False, False, False, False, True]
    assert rows[1]["suppressed"] == "duplicate" and rows[2]["suppressed"] == "banking" and rows[4]["penalty"] == -18 and rows[5]["timeliness"] == 3


def test_months_and_language_purity(spark):
    assert events.last_months("2026-02-01") == ["2025-09", "2025-10", "2025-11", "2025-12", "2026-01", "2026-02"]
    said = [("the market and the customer", False, True), ("thị trường của khách hàng", True, False), ("plan for thị", True, False), ("“the market and the customer” tốt", True, True), ("", False, False)]
    df = spark.createDataFrame(said, "t string, vi boolean, en boolean")
    assert df.where((intelligence.likely_language(F.col("t"), True) != F.col("vi")) | (intelligence.likely_language(F.col("t"), False) != F.col("en"))).count() == 0


def test_repairs_and_embedded_objects(spark):
    assert repair.repaired('{"a": "he said "no" twice", "b": "x\\"y"}') == '{"a": "he said \\"no\\" twice", "b": "x\\"y"}'
    assert repair.repaired('{"a": "b"}') == '{"a": "b"}'
    assert repair.balanced_object('x = {"a": "}", "b": {"c": 1}}; {') == '{"a": "}", "b": {"c": 1}}'
    assert repair.balanced_object("none") is None and repair.balanced_object("{open") is None
    assert repair.article_nodes('{"x": [{"_content_type_uid": "article", "post_date": "d", "title": "t", "in": {"_content_type_uid": "article", "post_date": "e"}}]}') == [("t", "d"), ("", "e")]
    assert repair.article_nodes("no json") == []


def test_reader_pages(spark):
    page = "Title: Shown\nMarkdown Content:\n* [Home](/h)\n# Head\n![x](a.png) **Bold** [link](http://l)\n| --- | --- |\n- point\n" + "word " * 80 + "\n## Tin liên quan\n* more"
    row = spark.range(1).select(web.reader_article(F.lit(page)).alias("a"), web.reader_article(F.lit("# T\nshort")).alias("b")).first()
    assert row["a"]["title"] == "Shown" and row["a"]["problem"] is None and row["b"]["problem"] == "TOO_SHORT" and row["b"]["title"] == "T"
    assert row["a"]["text"].startswith("Head\n Bold link\n") and "• point" in row["a"]["text"] and row["a"]["text"].endswith("word") and "Home" not in row["a"]["text"]


def test_shapes_of_the_unsql_queries(spark):
    folder = "/root/testdata/sf0.001"
    batch = selections.analyst_batch(spark, folder).collect()
    assert len({r["id"] for r in batch}) == len(batch) <= selections.BUDGET and sorted(r["pick"] for r in batch) == list(range(1, len(batch) + 1))
    assert {r["title"] for r in selections.reader_articles(spark, folder).where("id % 3 = 0").collect()} == {"Shown"}
    assert set(rules.QUERIES) >= {"m06_materiality", "m17_publication_gate"} and text.QUOTES


def test_near_classes_of_stories_meet_through_their_first_rows(spark):
    """18 common words of 25 are 72 %; equal sets of hashed runs of three words are one class."""
    words = [f"w{k}" for k in range(25)]
    rows = [(1, words), (2, words[:18]), (3, words[:17]), (4, words[::-1])]
    found = {(r["a"], r["b"]): r["overlap"] for r in dedup.class_pairs(spark.createDataFrame(rows, "id long, w array<string>"), 72).collect()}
    assert found == {(1, 2): 0.72, (2, 3): pytest.approx(17 / 18), (1, 4): 1.0}


def told(pairs, order):
    """Complete-link groups by a loop over all rows: each joins the first group that it is a pair with every member of."""
    groups = []
    for k in order:
        group = next((g for g in groups if all((min(k, m), max(k, m)) in pairs for m in g)), None)
        groups.append([k]) if group is None else group.append(k)
    return {k: g[0] for g in groups for k in g}


def story_documents(spark, folder, docs):
    spark.createDataFrame([(k, t, "en", s, 1) for k, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{folder}/documents.parquet")
    return f"file://{folder}"


def test_every_copy_counts_for_its_own_day(spark, tmp_path):
    """Copies 100 and 105 lie 35 hours apart but 29 days from the first one, 1, and 106 is near to them in text and in days."""
    said = " ".join(f"word{k}" for k in range(100))
    folder = story_documents(spark, tmp_path, [(1, f"Title a {said}", "src4"), (100, f"Title a {said}", "src4"), (105, f"Title a {said}", "src4"), (106, f"Title a {said} more", "src4")])
    assert {r["id"]: r["story"] for r in selections.stories(spark, folder).collect()} == {1: 1, 100: 100, 105: 100, 106: 100}


@pytest.mark.parametrize("seed", [1, 2])
def test_stories_equal_a_loop_over_all_documents(spark, tmp_path, monkeypatch, seed):
    """Copies, near titles, near texts, short titles and empty texts, over four markets and 90 days."""
    monkeypatch.setattr(selection, "PACK", 40)
    monkeypatch.setattr(selection, "HELD", 30)
    chance = random.Random(seed)
    heads = [[f"h{k}", *(f"t{n}" for n in range(8))] for k in range(3)]
    bodies = [[f"b{k}x{n}" for n in range(60)] for k in range(4)]
    docs = []
    for k in range(260):
        head, body = list(chance.choice(heads)), list(chance.choice(bodies))
        if chance.random() < 0.5:
            head[chance.randrange(9)] = f"own{chance.randrange(6)}"
        if chance.random() < 0.5:
            body[chance.choice((0, 30, 59))] = f"own{chance.randrange(4)}"
        docs.append((k, chance.choice(("", "ab cd", " ".join(head) + "\n" + " ".join(body), " ".join(head) + "\n" + " ".join(body), " ".join(head) + f"\nalone {k}", f"alone{k} x\n" + " ".join(body))), f"src{chance.randrange(8)}"))
    folder = story_documents(spark, tmp_path, docs)
    rows = {r["id"]: r for r in bindings.documents(spark, folder).where("published is not null").join(bindings.sources(spark, folder).select(F.col("code").alias("source_code"), "market"), "source_code").select("id", "published", "market", "title", "text").collect()}
    split = lambda x: x.replace("\n", " ").split()
    grams = {k: {*zip(w, w[1:], w[2:], strict=False)} if len(w) >= 3 else {(x,) for x in w} for k, w in ((k, split(r["text"])) for k, r in rows.items())}
    titles = {k: {x for x in split(r["title"]) if len(x) >= 2} for k, r in rows.items()}
    alike = lambda a, b, percent: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)

    def same(a, b):
        x, y = rows[a], rows[b]
        if abs((x["published"] - y["published"]).days) > 14 or (x["market"] and y["market"] and x["market"] != y["market"]):
            return False
        return (min(len(titles[a]), len(titles[b])) >= 3 and alike(titles[a], titles[b], 72)) or alike(grams[a], grams[b], 88)

    pairs = {(a, b) for a in rows for b in rows if a < b and same(a, b)}
    expected = told(pairs, sorted(rows))
    assert {r["id"]: r["story"] for r in selections.stories(spark, folder).collect()} == expected
    assert 20 < len(set(expected.values())) < len(rows)


def test_only_the_first_of_a_kind_is_grouped(spark, monkeypatch):
    """10,000 copies of one day and market are one row for the sequential part."""
    seen = []
    rows = spark.range(10_000).select("id", F.col("id").alias("place"), (F.col("id") % 2 * 20).cast("int").alias("day"), F.lit("VN").alias("market"), F.lit(0).cast("long").alias("t"), F.lit(None).cast("long").alias("g"))
    monkeypatch.setattr(selection, "kept", lambda df, name, keep=selection.kept: seen.append((name, keep(df, name))) or seen[-1][1])
    found = selection.stories_of(rows, spark.createDataFrame([], "title boolean, a long, b long"), 14).groupBy("story").count().collect()
    assert {(r["story"], r["count"]) for r in found} == {(0, 5_000), (1, 5_000)} and dict(seen)["parts"].count() == 2
