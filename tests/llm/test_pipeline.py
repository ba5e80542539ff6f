"""The pipeline's stages against brute force on a small fixture, and on empty tables."""

import hashlib
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from attestry.llm import queries

from .test_operators import brute_components, brute_leaks, brute_lines, near_copies, tokenizer

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def save(spark, folder, docs):
    spark.createDataFrame(docs, SHAPE).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12 x13 x14")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontaminate", "bpe"]


def test_run_equals_brute_force(spark, tmp_path):
    rows = [(d, t) for d, t in near_copies()]
    rows += [(500, "few words"), (501, "a b c d e f g " * 9), (502, "start " + " ".join(f"x{k}" for k in range(1, 15)) + " and more words to the end")]
    rows += [(503 + k, "\n".join([f"first line of {k} stands here alone today", *[f"shared line {j} of many words" for j in range(4)], f"last line of {k} goes on"])) for k in range(3)]
    folder = f"file://{tmp_path}"
    save(spark, folder, [(d, t, "en", "s", len(t)) for d, t in rows])
    kept = []
    for d, text in rows:
        words = text.split()
        seen = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        again = {j for k, w in enumerate(seen) if seen.count(w) > 1 for j in range(k, k + 5)}
        if len(words) >= 10 and 100 * len(again) <= 20 * len(words):
            kept.append((d, text))
    lines = brute_lines(kept)
    kept = [(d, lines[d][0]) for d, _ in kept]
    groups = brute_components(kept)
    kept = [(d, t) for d, t in kept if groups[d][1] == d]
    leaks = {d for d, _ in brute_leaks(kept, [(1, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12 x13 x14")])}
    library, expected = tokenizer(), {}
    for d, text in kept:
        if d not in leaks:
            ids = library.encode(text, add_special_tokens=False).ids
            expected[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert 502 not in found and 500 not in found and found == expected


def test_learnt_rules_act_and_odd_rows_pass(spark, tmp_path):
    """Enough labels for a learnt list: what it rejects goes; nulls, repeated rows and a clashing column do no harm."""
    rows = []
    for d in range(120):
        bad = d % 3 == 0
        words = [f"w{d}x{k}" + ("#$%" if bad and k % 2 else "") for k in range(30)]
        rows.append((d, " ".join(words), "en", "s", 1, "clash"))
    rows += [(None, " ".join(f"none{k}" for k in range(20)), None, None, None, "c"), (None, None, "en", "s", 0, "c"), (200, "", "en", "s", 0, "c"), *[(201, " ".join(f"twice{k}" for k in range(20)), "en", "s", 1, "c")] * 2]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, SHAPE + ", __kept string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, int(d % 3 > 0), 0) for d in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.rules_stage(spark, docs, folder)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert {r["doc_id"] for r in kept.collect()} == {None, 201, *(d for d in range(120) if d % 3)}
    found = sorted((r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()), key=str)
    assert found == sorted([None, None, 201, 201, *(d for d in range(120) if d % 3)], key=str)


def test_run_on_empty_tables(spark, tmp_path):
    save(spark, f"file://{tmp_path}", [])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_all_thirteen_are_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 14))
