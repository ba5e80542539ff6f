"""Links within a band of time against loops over all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from attestry.bindings import documents
from attestry.operators import banded
from attestry.plans import dedup

BAND = 100


def overlap(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0


def linked_by_definition(rows, percent):
    """Pairs of rows (id, at, value, words): the one before of an equal value or set, and for the smaller class of two alike sets the nearest before and after."""
    out, order = set(), lambda r: (r[1], r[0])
    classes = {}
    for r in rows:
        for key in [("v", r[2])] * (r[2] is not None) + [("w", frozenset(r[3] or ()))] * bool(r[3]):
            classes.setdefault(key, []).append(r)
    for some in classes.values():
        some.sort(key=order)
        out |= {tuple(sorted((a[0], b[0]))) for a, b in itertools.pairwise(some) if b[1] - a[1] <= BAND}
    for (k, p), (m, q) in itertools.permutations(classes.items(), 2):
        size = lambda c: (len(c), -min(r[0] for r in c))
        if k[0] != "w" or m[0] != "w" or size(p) > size(q) or 100 * len(k[1] & m[1]) < percent * len(k[1] | m[1]):
            continue
        for r in p:
            before, after = [s for s in q if order(s) < order(r)][-1:], [s for s in q if order(s) > order(r)][:1]
            out |= {tuple(sorted((r[0], s[0]))) for s in before + after if abs(r[1] - s[1]) <= BAND}
    return out


def joined_up(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        root[find(a)] = find(b)
    return find


def links_of(spark, rows, percent):
    frame = spark.createDataFrame(rows, "id long, at long, value string, words array<string>").withColumn("words", banded.hashed(F.col("words")))
    return banded.banded_links(frame, BAND, ["value"], {"words": percent})


@pytest.mark.parametrize(("percent", "seed", "frequent", "slack"), [(50, 1, 200, 16), (80, 2, 200, 16), (92, 3, 3, 0), (100, 4, 1, -1), (75, 5, 10, -2)])
def test_links_equal_loops_over_all_pairs(spark, monkeypatch, percent, seed, frequent, slack):
    """Also where many tokens are frequent, and few are stored, so that sets are read again."""
    monkeypatch.setattr(banded, "FREQUENT", frequent)
    monkeypatch.setattr(banded, "SLACK", slack)
    chance = random.Random(seed)
    rows = []
    for k in range(160):
        words = [f"w{chance.randint(0, 12)}" for _ in range(chance.choice((0, 1, 3, 6, 12)))] if chance.random() < 0.7 else [f"c{n}" for n in range(12) if n != chance.randint(0, 14)]
        rows.append((k, chance.choice((chance.randint(0, 900), 100 * chance.randint(0, 9))), chance.choice((None, "a", "b", str(k))), words if chance.random() < 0.95 else None))
    found = links_of(spark, [*rows, rows[0], (500, None, "a", ["w1"]), (None, 5, "a", ["w1"])], percent).collect()
    distinct = [(k, at, v, sorted(set(w or ()))) for k, at, v, w in rows]
    assert {(r["a"], r["b"]) for r in found} == linked_by_definition(distinct, percent)
    assert len(found) == len({(r["a"], r["b"]) for r in found})
    by_id = {r[0]: r for r in distinct}
    for r in found:
        share = overlap(by_id[r["a"]][3], by_id[r["b"]][3])
        assert r["words"] == (pytest.approx(share) if 100 * share >= percent - 1e-9 and share else None)
    # no two rows that are alike within the band are left apart
    find = joined_up([(r["a"], r["b"]) for r in found], by_id)
    for a, b in itertools.combinations(distinct, 2):
        alike = (a[2] is not None and a[2] == b[2]) or (a[3] and b[3] and 100 * len(set(a[3]) & set(b[3])) >= percent * len(set(a[3]) | set(b[3])))
        if alike and abs(a[1] - b[1]) <= BAND:
            assert find(a[0]) == find(b[0])


def test_thousands_of_copies_give_few_links(spark):
    copies = [(k, k % 50, "same", ["x", "y", "z"]) for k in range(3_000)]
    near = [(10_000 + k, 25 + k, None, ["x", "y", "z", f"u{k}"]) for k in range(40)]
    found = {(r["a"], r["b"]) for r in links_of(spark, copies + near, 75).collect()}
    assert len(found) <= 2_999 + 2 * 40 + 40 * 39
    find = joined_up(found, [r[0] for r in copies + near])
    assert len({find(r[0]) for r in copies + near}) == 1


def test_timelines_are_cut_within_a_class(spark):
    rows = spark.range(4_000).select(F.lit("one").alias("key"), F.col("id").alias("at"), "id", (F.col("id") % 7 == 3).alias("ask"))
    for r in banded.nearest(rows).collect():
        before = [k for k in range(r["id"] - 1, r["id"] - 3, -1) if k >= 0 and k % 7 != 3][:1]
        after = [k for k in range(r["id"] + 1, r["id"] + 3) if k < 4_000 and k % 7 != 3][:1]
        assert (r["before"] and r["before"]["id"]) == (before[0] if before else None) and (r["after"] and r["after"]["id"]) == (after[0] if after else None)


def test_a_timeline_is_passed_once_each_way(spark):
    """A frame that is open at its end costs Spark the square of a class's rows; ties of time are in the order of ids."""
    chance = random.Random(7)
    rows = [(f"k{chance.choice((0, 0, 0, 1, 2))}", chance.randint(0, 60), k, chance.random() < 0.6) for k in range(400)] + [("asked", 5, 900, True), ("told", 5, 901, False)]
    found = banded.nearest(spark.createDataFrame(rows, "key string, at long, id long, ask boolean"))
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    told = {key: sorted((at, k) for other, at, k, ask in rows if other == key and not ask) for key, *_ in rows}
    expected = {(key, at, k, ask): (max((x for x in told[key] if x < (at, k)), default=None), min((x for x in told[key] if x > (at, k)), default=None)) for key, at, k, ask in rows}
    assert {(r["key"], r["at"], r["id"], r["ask"]): (r["before"] and tuple(r["before"]), r["after"] and tuple(r["after"])) for r in found.collect()} == expected


def test_a_near_copy_of_a_late_copy_has_its_row(spark, tmp_path):
    """Documents 1 and 20 hold one text, 133 hours apart; 21 has one word more, 7 hours after 20."""
    text = " ".join(f"word{k}" for k in range(200))
    docs = [(k, text, "en", f"src{k % 3}", 1) for k in (1, 20)] + [(21, text + " more", "en", "src1", 1), (22, "other words", "en", "src1", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    at = {r["id"]: r["at"] for r in documents(spark, f"file://{tmp_path}").select("id", F.unix_timestamp("published_at").alias("at")).collect()}
    assert at[20] - at[1] > 72 * 3600 >= at[21] - at[20]
    rows = dedup.pair_verdicts(spark, f"file://{tmp_path}").collect()
    assert [(r["a"], r["b"], r["method"], r["verdict"]) for r in rows] == [(20, 21, "JACCARD_TITLE", "DUPLICATE_CONTENT")] and rows[0]["content_overlap"] > 0.92


def test_links_carry_columns_and_equal_values(spark):
    """Callers judge pairs without reading the rows again; a null value equals none."""
    rows = spark.createDataFrame([(1, 0, "u", "x", [5, 6]), (2, 9, "u", "y", [6, 5]), (3, 12, None, "z", [5, 6, -7])], "id long, at long, value string, extra string, words array<long>")
    found = {(r["a"], r["b"]): (r["same_value"], r["a_extra"], r["b_extra"], r["words"]) for r in banded.banded_links(rows, BAND, ["value"], {"words": 60}, beside=("extra",)).collect()}
    assert found == {(1, 2): (True, "x", "y", 1.0), (2, 3): (False, "y", "z", pytest.approx(2 / 3))}


def brute_pairs(rows, percent):
    """First rows of equal sets, and pairs of them that are alike."""
    first = {}
    for k, w in rows:
        if w:
            first.setdefault(frozenset(w), k)
    return {(min(i, j), max(i, j)) for (s, i), (u, j) in itertools.combinations(first.items(), 2) if 100 * len(s & u) >= percent * len(s | u)}


@pytest.mark.parametrize(("carried", "sketched", "frequent", "slack"), [(256, 1024, 200, 16), (0, 1024, 5, 0), (0, 0, 5, 0), (20, 0, 1, 16), (20, 8, 3, 0)])
def test_set_pairs_equal_brute_force(spark, monkeypatch, carried, sketched, frequent, slack):
    for name, value in (("CARRIED", carried), ("SKETCHED", sketched), ("FREQUENT", frequent), ("SLACK", slack)):
        monkeypatch.setattr(banded, name, value)
    chance, base = random.Random(11), [f"b{k}" for k in range(25)]
    rows = [(k, [w for w in base if chance.random() > chance.choice((0, 0.05, 0.1, 0.3))] if k % 2 else chance.sample("abcdefgh", chance.randint(0, 5))) for k in range(140)]
    members, pairs = banded.set_pairs(spark.createDataFrame([*rows, rows[1]], "k long, w array<string>"), "k", "w", 72)
    found = [(r["a"], r["b"]) for r in pairs.collect()]
    assert set(found) == brute_pairs(rows, 72) and len(found) == len(set(found))
    sets = dict(rows)
    assert {r["row"]: r["first"] for r in members.collect()} == {k: min(j for j in sets if set(sets[j]) == set(w)) for k, w in rows if w}


@pytest.mark.parametrize("length", [8, 400])
def test_unlike_sets_that_share_frequent_tokens_are_no_candidates(spark, monkeypatch, length):
    """Sets of few frequent words, and long ones, are told apart where they meet: only answers are stored and compared."""
    stored, keep = {}, banded.kept
    monkeypatch.setattr(banded, "kept", lambda df, name: stored.setdefault(name, keep(df, name)))
    chance = random.Random(2)
    words = [f"w{k}" for k in range(3 * length)]
    rows = [(k, chance.sample(words, length)) for k in range(300)] + [(900, words[:length]), (901, [*words[:length], "more"])]
    found = {(r["a"], r["b"]) for r in banded.set_pairs(spark.createDataFrame(rows, "k long, w array<string>"), "k", "w", 80)[1].collect()}
    assert (900, 901) in found and stored["met"].count() == len(found)


@pytest.mark.parametrize("block", [1 << 21, 12_000])
def test_large_sets_go_to_blocks_and_not_to_pairs(spark, monkeypatch, block):
    """40 sets, all alike, and two of another kind: 781 pairs, each set once for every pair of blocks."""
    monkeypatch.setattr(banded, "BLOCK", block)
    words = list(range(200))
    sets = {k: [w for w in words if w % 50 != k] for k in range(40)} | {100: list(range(1000, 1300)), 101: list(range(1000, 1290))}
    rows = spark.createDataFrame(list(sets.items()), "id long, w array<long>")
    pairs = [(p, q, len(sets[p]), len(sets[q])) for p, q in itertools.combinations(sets, 2) if (p < 100) == (q < 100)]
    asked = spark.createDataFrame(pairs, "p long, q long, np int, nq int")
    dealt, given = banded.blocked(asked, rows, "w")
    blocks = len({b for r in dealt.collect() for b in (r["bp"], r["bq"])})
    assert blocks == 1 if block > 12_000 else 2 < blocks < 12
    assert given.count() <= len(sets) * (2 * blocks - 1) and dealt.count() == len(pairs)
    found = {(r["p"], r["q"]): r["common"] for r in banded.counted(asked, rows, "w", 97).collect()}
    assert found == {(p, q): len(set(sets[p]) & set(sets[q])) for p, q, n, m in pairs if 197 * len(set(sets[p]) & set(sets[q])) >= 97 * (n + m)}
