"""Licence scans, periodic runs and whitening against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from attestry.llm import license_scan, periodic_runs, whitening
from attestry.llm.queries import QUERIES

DOCS = "doc_id long, text string, n_words string, runs int, score string, x int"
FOLDER = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", 1) for r in rows], DOCS)


# ---- periodic runs


def runs_by_definition(words):
    """Every stretch of smallest period q that can't be extended, by trying all periods."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            part = words[start : i + q]
            if i > start and length >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((start, length, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted_words(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected_runs(doc_id, text):
    words = planted_words(doc_id, text)
    runs = runs_by_definition(words)
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *top, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))


def repeating_texts(n, seed):
    chance, texts = random.Random(seed), []
    for _ in range(n):
        words = []
        for _ in range(chance.randint(0, 4)):
            block = [chance.choice(chance.choice(("ab", "abcdefgh"))) for _ in range(chance.randint(1, 12))]
            words += block * chance.randint(1, 8) + block[: chance.randint(0, len(block))]
        texts.append(chance.choice((" ", "\n", " \t")).join(words))
    return texts


def test_runs_of_texts_that_are_named_together():
    texts = repeating_texts(600, 2)
    for size in (1, 7, 600):
        for at in range(0, 600, size):
            split = [t.encode().split() for t in texts[at : at + size]]
            for words, row in zip(split, periodic_runs.judged(list(range(len(split))), split).to_pylist(), strict=True):
                assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == runs_by_definition(words)
                assert row["n_words"] == len(words)


@pytest.mark.parametrize("words", [["a"] * 5, ["a"] * 6, list("abab"), list("ab" * 3), list("ab" * 4), list("abc" * 4), list("abc" * 4)[:-1], ["a"] * 6 + ["b"] + ["a"] * 6, list("aabaabaabaab" * 5), list("abaab" * 4 + "abaabaab" * 4)])
def test_runs_at_their_limits(words):
    row = periodic_runs.judged([1], [[w.encode() for w in words]]).to_pylist()[0]
    assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == runs_by_definition(words)


def test_a_long_text_with_a_long_period_and_one_word_repeated():
    chance = random.Random(4)
    block = [str(chance.random()).encode() for _ in range(50_000)]
    rows = periodic_runs.judged([1, 2], [block * 4 + block[:7], [b"w"] * 300_000]).to_pylist()
    assert [r["runs"] for r in rows] == [[{"start": 0, "length": 200_007, "period": 50_000}], [{"start": 0, "length": 300_000, "period": 1}]]
    assert rows[0]["collapsed"] == b" ".join(block).decode() and rows[1]["collapsed"] == "w"


def test_runs_query_rows(spark):
    texts = repeating_texts(150, 9) + ["", None, " \n\t", "é é é é é é 日本 日本", "a b " * 6, "a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb", "x y z " * 40 + "end"]
    rows = [*((k, t) for k, t in enumerate(texts)), (3, texts[3]), (None, "b b b b b b b"), (7, "w " * 9)]
    found = periodic_runs.digests(periodic_runs.runs(periodic_runs.planted(frame(spark, rows))))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((expected_runs(*r) for r in rows), key=str)


def test_runs_of_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    short = {k: t for k, t in rows if len(t) < 4000}
    found = {r["doc_id"]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    assert len(found) == len(rows) and {k: found[k] for k in short} == {k: expected_runs(k, t) for k, t in short.items()}
    assert sum(found[k][1] > 0 for k, _ in rows) > 10


# ---- licence scans


def stretches(templates):
    return {tuple(t[a:b]) for t in templates for a in range(len(t)) for b in range(a + 1, len(t) + 1)}


def test_matching_statistics_and_occurrences():
    chance = random.Random(1)
    for _ in range(300):
        templates = [[chance.randint(0, 2) for _ in range(chance.randint(1, 9))] for _ in range(chance.randint(1, 5))]
        made, known = license_scan.Automaton.of(templates), stretches(templates)
        text = [chance.randint(0, 2) for _ in range(30)]
        text = [w for w in text if any(w in t for t in templates)]
        for at, (state, held) in enumerate(made.statistics(text)):
            longest = max(k for k in range(at + 2) if not k or tuple(text[at + 1 - k : at + 1]) in known)
            assert held == longest
            part = text[at + 1 - held : at + 1]
            assert made.ends[state] == [(k, e) for k, t in enumerate(templates) for e in range(len(t)) if held and t[max(0, e + 1 - held) : e + 1] == part]


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(label, k) for label, phrase in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for _, k in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for label, _ in hits}))


def phrase_texts(n, seed):
    chance = random.Random(seed)
    some = "cc by CC-BY general General public PUBLIC license all rights reserved Reserved. , under the mit Licensed work of é 日本 x İ K by-nc 4.0 free".split()
    return ["".join(chance.choice(some) + chance.choice((" ", "\n", "-", ", ", " ")) for _ in range(chance.randint(0, 60))) for _ in range(n)]


def test_base_places_equal_a_plain_search(spark):
    texts = phrase_texts(500, 6) + [None, "", "cc by " * 3000, "all rights reserved all rights reserved", "CC\x00BY", "cc", "by"]
    rows = [*enumerate(texts), (None, "cc by"), (1, "general public license"), (1, "general public license")]
    found = license_scan.digests(license_scan.scans(frame(spark, rows)))
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = found.collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(((k, *base_places(t)) for k, t in rows), key=str)
    for r in got:
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) >= (r["n_base"] > 0)
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(filter(None, r["base_labels"].split(","))) <= set(labels)


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("Some prose. Released under the MIT License. More.", [("mit", 2, 6)]),
        ("Released under the bridge", []),
        ("This was released under the terms", []),
        ("Licensed under the Apache License, Version 2.0.", [("apache-2.0", 0, 7)]),
        ("Licensed under CC BY-NC 4.0.", [("cc-by-nc", 0, 6)]),
        ("Licensed under CC BY-SA 4.0.", [("cc-by-sa", 0, 6)]),
        ("This work is licensed under the GNU General Public License, version 2.", [("gpl", 0, 10)]),
        ("permission is hereby granted free of charge to any lucky person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", [("mit", 0, 29)]),
        ("Released under the MIT License. Released under the MIT License.", [("mit", 0, 4), ("mit", 5, 9)]),
        ("the the the the of of of", []),
    ],
)
def test_spans_of_notices(text, spans):
    found = license_scan.Scanner().scanned(license_scan.words_of(text))[1]
    assert [s[:3] for s in found] == spans and all(0.75 <= s[4] <= 1 for s in found)


def test_chains_of_long_texts_and_own_templates():
    scanner = license_scan.Scanner((("p", "a b"),), (("n", "a b c d e f g h"),))
    text = license_scan.words_of("a b c x d e f g h " + "q " * 50 + "a b c d " + "z " * 20 + "e f g h")
    places, spans, score = scanner.scanned(text)
    assert [p[:2] for p in places] == [("p", 0), ("p", 59)] and spans == [("n", 0, 8, 8, 1.0)] and score == 1.0
    many = license_scan.words_of("released under the mit license " * 20_000)
    assert len(license_scan.Scanner().scanned(many)[1]) == 20_000
    with pytest.raises(ValueError, match="templates"):
        license_scan.Scanner((("p", "a " * ((1 << 20) + 1)),), ())


def test_license_query_finds_the_planted_lines(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    found = {r["doc_id"]: r for r in QUERIES["op11_license_scan"](spark, "/root/testdata/sf0.01").collect()}
    assert {k: tuple(r)[1:6] for k, r in found.items()} == {k: base_places(t) for k, t in rows.items()}
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "GNU General Public License": "gpl", "All rights reserved.": "reserved"}
    for k, text in rows.items():
        wanted = {label for line, label in lines.items() if line in text}
        assert wanted <= set(found[k]["labels"].split(",")), (k, wanted)
        assert wanted or found[k]["labels"] == "", k


# ---- whitening


VECTORS = "vec_id long, embedding array<float>, n string, component string"


def by_definition(rows, most=4):
    """(vec_id, component): (n, deviation, |whitened|, explained), with eigenvectors of numpy."""
    sound = [(k, [int(np.floor(256 * float(c))) for c in v]) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in sound}), object)
    n, sums = len(fit), fit.sum(0)
    apart = fit * n - sums
    v = (apart.T @ apart).astype(float) / n**3
    values, vectors = np.linalg.eigh(v)
    values = np.maximum(values, 0)
    out = []
    for k, x in sound:
        dev = np.array(x, object) * n - sums
        for c in range(1, min(most, len(sums)) + 1):
            e = values[-c]
            out.append((k, c, n, int((dev * dev).sum()), abs(float((dev / n).astype(float) @ vectors[:, -c]) / max(e, 1e-300) ** 0.5), e / v.trace()))
    return out


def close(found, expected):
    key = lambda r: (str(r[0]), r[1], round(abs(r[4]), 4))
    found, expected = sorted(found, key=key), sorted(expected, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    np.testing.assert_allclose([abs(r[4]) for r in found], [r[4] for r in expected], rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose([r[5] for r in found], [r[5] for r in expected], rtol=1e-9)
    assert all(r[6] < 1e-9 for r in found) and len({r[6] for r in found}) <= 1


def test_whitening_of_the_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    found = QUERIES["op13_whitening"](spark, FOLDER)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = found.collect()
    close(found, by_definition(rows))
    for c in (1, 2, 3, 4):  # one sign for all rows of a component: the mean of the signed values is theirs
        values = np.array([r["whitened"] for r in found if r["component"] == c])
        assert abs(values.mean()) < 1e-9 and abs(values.var() - 1) < 1e-9


def test_whitening_of_odd_rows(spark):
    chance = np.random.default_rng(3)
    rows = [(k, [float(v) for v in np.float32(chance.normal(size=3) * (9, 1, 0.1) + 50)]) for k in range(60)]
    rows += [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 1.0, 1.0]), (None, rows[0][1]), (0, rows[0][1]), (104, [-0.001, -0.0, 0.0])]
    rows += [(200 + k, rows[1][1]) for k in range(40)]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS)
    close(whitening.whitened(frame).collect(), by_definition(rows))
    uneven = spark.createDataFrame([*rows, (300, [1.0]), (301, [1.0, 2.0, 3.0, 4.0]), (302, [])], "vec_id long, embedding array<float>")
    close(whitening.whitened(uneven).collect(), by_definition(rows))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_whitening_without_a_direction(spark, rows):
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert found.collect() == [] and len(found.columns) == 7


def test_whitening_of_fewer_directions_than_entries(spark):
    rows = [(k, [float(k), 2.0 * k, 5.0, float(k * k)]) for k in range(9)]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    close(found, [r for r in by_definition(rows) if r[1] <= 2])


def test_small_directions_keep_their_digits():
    """Eigenvalues over 42 powers of ten, on turned axes, to nearly full precision."""
    size, chance = 8, random.Random(7)
    scatter = np.array([[0] * size for _ in range(size)], object)
    scales = [10 ** (22 - 3 * k) for k in range(size)]
    for _ in range(40):
        row = np.array([chance.randint(-999, 999) * s for s in scales], object)
        scatter = scatter + np.multiply.outer(row, row)
    turned = whitening.one_sided_jacobi(whitening.pivoted_cholesky(scatter))
    norms = np.sort((turned * turned).sum(0))
    inverse = np.array([[Fraction(int(v)) for v in row] for row in scatter], object)
    # the product of the eigenvalues is the determinant, and their sum the trace
    det = Fraction(1)
    for k in range(size):
        det *= inverse[k, k]
        for i in range(k + 1, size):
            inverse[i] = inverse[i] - inverse[k] * (inverse[i, k] / inverse[k, k])
    assert abs(float(np.prod([Fraction(float(v)) for v in norms]) / det) - 1) < 1e-12
    assert abs(norms.sum() / float(sum(scatter.diagonal())) - 1) < 1e-13
    unit = turned / np.sqrt((turned * turned).sum(0))
    np.testing.assert_allclose(unit.T @ unit, np.eye(size), atol=1e-12)


def test_sums_beyond_the_range_of_doubles():
    chance = random.Random(5)
    for top in (10, 1 << 24, 1 << 40, 1 << 62):
        y = np.array([[chance.randint(-top, top) for _ in range(3)] for _ in range(20)], np.int64)
        assert (whitening.product(y).astype(object) == y.astype(object).T @ y.astype(object)).all()
        assert whitening.totals(y).tolist() == [[20, *y.astype(object).sum(axis=0).tolist()]]
        assert whitening.less(y, [1 << 62, -5, 0]).tolist() == (y.astype(object) - np.array([1 << 62, -5, 0], object)).tolist()


def test_queries_on_empty_tables(spark):
    none = frame(spark, []).where("false")
    assert periodic_runs.digests(periodic_runs.runs(periodic_runs.planted(none))).collect() == []
    assert license_scan.digests(license_scan.scans(none)).collect() == []
