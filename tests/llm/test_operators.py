"""The operators against brute force, exact round trips and held-out rows, and on odd tables."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from attestry.llm import bpe, components, decontaminate, jaccard_join, line_dedup, lm_score, quality_model, quality_rules, token_files, toxicity, warc

from pyspark.sql import functions as F

from attestry.llm.common import Memo, bounded_labelled_sample, shared_folder
from attestry.llm.hashing import Hasher

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "s", None), (2, "", None, None, 0), (3, " \t\n", "en", "s", 3), (4, "one", "en", "s", 3), (5, "same words stand here twice", "en", "s", 1),
    (6, "same words stand here twice", "en", "s", 1), (6, "same words stand here twice", "en", "s", 1), (None, "no id at all here", "en", "s", 1), (7, "é日本<|endoftext|> ΣΑΣ İ́ #*$", "x", "s", 1),
    (8, "word " * 30_000, "en", "s", 1), (9, "\n".join(["a b", "", "c d", "e f", "a b", "c d", "e f", "z"]), "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(1, 10)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_memo_keeps_what_is_used():
    asked = []
    memo = Memo(lambda new: asked.append(set(new)) or {w: w.upper() for w in new}, 3)
    for words in (["a", "b"], ["a", "c", "d", "e"], ["a", "e"], ["a", "b"]):
        assert memo.recall(words) == [w.upper() for w in words]
    assert not any("a" in a for a in asked[1:])


# ---- WARC


def expected_records(rows):
    """(bytes, digest, type, target) of each row by page id, for rows with one null id at most."""
    last = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if page_id is not None:
            last[body] = max(page_id, last.get(body, page_id))
    out = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        revisit = page_id is not None and page_id != last[body]
        out[page_id] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", last[body] if revisit else None)
    return out


def test_warc_round_trip(spark):
    rows = [(1, "http://www.A.com:80/x?b=2&a=1#f", "hi"), (2, None, "hi"), (3, "http://b.org/\t x", None), (4, "http://a.com/x?a=1&b=2", ""), (None, "u", "hi"), (5, "http://a.com/y", "hi"), (6, "http://big/", "é" * 9_000_000), (7, "http://c/", "<p>" * 9)]
    pages = spark.createDataFrame([(*r, "clash", "clash", 5) for r in rows], "page_id long, url string, html string, payload string, target string, size long")
    folder = shared_folder(spark, "warc-test")
    warc.write_archives(pages, folder, per_file=3)
    warc.write_index(spark, folder, lines=2)
    found = {r["page_id"]: tuple(r)[1:] for r in warc.read_back(spark, folder, warc.wanted_captures(pages)).collect()}
    assert found == expected_records(rows)
    hits = warc.lookup(spark, folder, "https://www.a.com/y")
    assert [(h["page"], h["payload"]) for h in hits] == [("5", b"hi")]
    assert warc.lookup(spark, folder, "http://nowhere/") == []


def test_warc_with_thousands_of_pages_under_one_url_and_under_none(spark):
    rows = [(k, "http://one.org/" if k % 2 else None, f"page {k // 3}") for k in range(6000)]
    pages = spark.createDataFrame(rows + [(None, None, "page 1")] * 600, "page_id long, url string, html string")
    folder = shared_folder(spark, "warc-test")
    found = warc.written_and_read(pages, folder).collect()
    assert sum(r["page_id"] is None for r in found) == 600
    assert {r["page_id"]: tuple(r)[1:] for r in found if r["page_id"] is not None} == expected_records(rows)
    directory = warc.Directory.load(spark, folder)
    assert len(directory.rows) > 20 and all(len(directory.blocks("org,one)/", str(k))) <= 2 for k in range(1, 6000, 97))
    assert len(warc.lookup(spark, folder, "http://one.org")) == 3000


@pytest.mark.parametrize("rows", [[(3, "AAAA"), (5, "AAAA"), (5, "BBBBBB")], [(5, "A"), (5, "A"), (3, "A"), (3, "A"), (3, "B"), (9, "B"), (9, "A"), (None, "A")]])
def test_warc_records_of_one_page_id_and_several_payloads(spark, rows):
    """As many rows as pages, each with the digest and size of its own payload."""
    pages = spark.createDataFrame([(page, f"http://x/{k % 2}", html) for k, (page, html) in enumerate(rows)], "page_id long, url string, html string")
    last = {html: max(p for p, h in rows if h == html and p is not None) for _, html in rows}
    expected = [(p, len(h), warc.digest(h.encode()), *(("revisit", last[h]) if p is not None and p != last[h] else ("response", None))) for p, h in rows]
    assert sorted(map(tuple, warc.written_and_read(pages).collect()), key=str) == sorted(expected, key=str)


def test_warc_of_nothing_and_members(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.written_and_read(none).count() == 0
    for data in (b"", b"x", bytes(1 << 24)):
        assert gzip.decompress(warc.member(data) + b"\0") == data


# ---- BPE and token files


def random_texts(n=400, seed=5):
    chance = random.Random(seed)
    signs = "aбΣσςİßéé \t\x1c\x85\xa0 'sStTrReEvVmMdDlL 12²Ⅷ<|>,.endoftext日本😀ﬁ​%#ÅJ̌\n\x00"
    out = ["".join(chance.choice(signs) for _ in range(chance.randint(0, 16))) for _ in range(n)]
    return out + [t[:4] + "<|endoftext|>" + t[4:] for t in out[:80]] + ["", "It's the words' end.", "ΑΣ ΑΣ. Σ", "<|ENDOFTEXT|>"]


def test_bpe_equals_the_library():
    spelling, library = bpe.Vocabulary(bpe.default_vocabulary()), tokenizer()
    words = ["the", "thing", "things", "thin", "zz", "日本"]
    encoder = bpe.Encoder(spelling, bpe.Lexicon.compile({w: spelling.merge(w) for w in words}))
    texts = random_texts()
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert list(ids) == expected, text
        assert encoder.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_a_long_run_without_spaces_merges_like_the_library():
    spelling, chance = bpe.Vocabulary(bpe.default_vocabulary()), random.Random(1)
    encoder, library = bpe.Encoder(spelling, bpe.Lexicon.compile({}), known_runs=50), tokenizer()
    for word in ("".join(chance.choice("abcdefghijklmnop") for _ in range(200_000)), "ab" * 50_000, "a" * 4_097, "a\u00a0b\x1cc"):
        assert next(encoder.encode_all([word])) == library.encode(word, add_special_tokens=False).ids


def test_lexicon_finds_all_its_words_and_no_others(tmp_path):
    chance = random.Random(1)
    words = {"".join(chance.choice("abcé") for _ in range(chance.randint(1, 6))) for _ in range(500)}
    entries = {w: [k, k + 1][: 1 + k % 2] for k, w in enumerate(sorted(words))}
    bpe.Lexicon.compile(entries).save(str(tmp_path / "l"))
    lexicon = bpe.Lexicon.mapped(str(tmp_path / "l"))
    asked = [*words, "zz", "abcabcabcabc", "é" * 9]
    for word, slot in zip(asked, lexicon.slots([w.encode() for w in asked]).tolist(), strict=True):
        assert (lexicon.ids_of(slot) if slot >= 0 else None) == entries.get(word)
    assert len(lexicon.final) < sum(map(len, words))  # suffixes are shared
    assert bpe.Lexicon.compile({}).slots([b"a"]).tolist() == [-1]


def test_bpe_query_rows(spark, odd, empty):
    library = tokenizer()
    found = bpe.round_trip_digests(odd).collect()
    assert len(found) == len(ODD)
    expected = []
    for doc_id, text, *_ in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert bpe.round_trip_digests(empty).count() == 0
    lexicon = bpe.Lexicon.compile({})
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(odd, lexicon=lexicon)).collect()}
    assert texts[4] == "one</w>"


def test_codes_of_any_length_come_back():
    values = np.array([0, 1, 255, 256, 65_535, 65_536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1] * 7, "<u4")
    for n in range(len(values)):
        control, data = token_files.pack(values[:n])
        assert (token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == values[:n]).all()
    parts = [values[:n] for n in (1, 4, 0, 7, 63)]
    packed = token_files.pack_all(parts)
    assert packed == [token_files.pack(p) for p in parts]
    back = token_files.unpack_all(*([np.frombuffer(p[k], np.uint8) for p in packed] for k in (0, 1)), [len(p) for p in parts])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(back, parts, strict=True))


def test_token_files_round_trip(spark, odd, empty):
    library = tokenizer()
    texts = random_texts(seed=6)
    for text, ids in zip(texts * 2, token_files.RunEncoder(bpe.default_vocabulary(), 50).encode_all(texts * 2), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    folder = shared_folder(spark, "token-test")
    token_files.write(odd, folder, shard_documents=3)
    found = sorted(token_files.read(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    ids_of = {(d, t): [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t, *_ in ODD}
    start = 0
    assert [r["doc_id"] for r in found] == [None, *sorted(d for d, *_ in ODD if d is not None)]
    for row in found:
        assert (row["start"], row["n_tokens"]) == (start, len(row["ids"]))
        assert row["ids_crc32"] == zlib.crc32(np.array(row["ids"], "<u4").tobytes())
        assert list(row["ids"]) in [v for (d, _), v in ids_of.items() if d == row["doc_id"]]
        start += row["n_tokens"]
    assert token_files.written_and_read(empty).count() == 0


# ---- decontamination


def brute_leaks(docs, items):
    found = {}
    for d, text in docs:
        words = decontaminate.words_of(text)
        for i, item in items:
            own = decontaminate.words_of(item)
            best = 0
            for shift in range(1 - len(own), len(words)):
                equal = [0 <= shift + q < len(words) and words[shift + q] == own[q] for q in range(len(own))]
                best = max(best, max(sum(equal[q : q + 13]) for q in range(len(own))))
            if best >= (10 if len(own) >= 13 else math.ceil(len(own) * 10 / 13)):
                found[d, i] = best
    return found


def test_leaks_equal_brute_force(spark):
    chance = random.Random(2)
    pool = [f"w{k}" for k in range(30)] + ["the", "of", "in"] * 5
    items = [(i, " ".join(chance.choice(pool) for _ in range(chance.choice([13, 14, 20, 30])))) for i in range(10)]
    docs = []
    for d in range(80):
        words = [chance.choice(pool) for _ in range(chance.randint(0, 50))]
        own = chance.choice(items)[1].split()
        begin = chance.randint(0, len(own) - 13)
        part = [w if chance.random() > 0.2 else chance.choice(pool) for w in own[begin : begin + chance.randint(8, 16)]]
        if d % 2:
            words[len(words) // 2 : len(words) // 2] = part
        docs.append((d, " ".join(words)))
    documents, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")
    expected = brute_leaks(docs, items)
    assert expected
    found = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in decontaminate.leaks(documents, benchmark).collect()}
    assert found == expected
    kept = {r["doc_id"] for r in decontaminate.decontaminated(documents, benchmark).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in expected}


def test_leaks_on_odd_tables(spark, odd, empty):
    short = spark.createDataFrame([(1, "same words stand here twice"), (2, "same words stand here twice"), (3, "...")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, short).collect()} == {(d, i) for d in (5, 6) for i in (1, 2)}
    assert decontaminate.leaks(empty, short).count() == 0
    assert decontaminate.leaks(odd, short.where("false")).count() == 0
    assert decontaminate.decontaminated(odd, short).count() == len(ODD) - 3


def test_a_passage_of_many_items_in_a_long_text_and_repeated_words(spark):
    passage = " ".join(f"p{k}" for k in range(14))
    items = [(k, f"start{k} {passage} end{k}") for k in range(300)] + [(300, "word " * 200)]
    docs = [(1, " ".join(f"x{k}" for k in range(9_000)) + f" {passage}"), (2, "word " * 30_000), (None, passage), (None, "clean text")]
    documents = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, seed long, item_id long")
    benchmark = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    found = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["first_word"]) for r in decontaminate.leaks(documents, benchmark).collect()}
    assert found == {**{(d, k): (13, 9_000 if d else 0) for d in (1, None) for k in range(300)}, (2, 300): (13, 0)}
    kept = decontaminate.decontaminated(documents.withColumn("__leak", documents.doc_id), benchmark)
    assert kept.columns[-1] == "__leak" and kept.count() == 0  # rows without an id are judged together


def test_short_items_with_every_allowed_substitution(spark):
    docs, items = [], []
    for n in range(1, 13):
        words = [f"n{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for gone in range(n - math.ceil(n * 10 / 13) + 2):  # one more than allowed, too
            for places in itertools.combinations(range(n), gone):
                other = " ".join("other" if k in places else w for k, w in enumerate(words))
                docs += [(len(docs), other), (len(docs) + 1, f"before {other} after")]
    expected = brute_leaks(docs, items)
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["n_matched"] for r in found.collect()} == expected


# ---- Jaccard join


def brute_components(rows):
    sets, best = {}, {}
    for i, text in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
    ids = list(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    for i in ids:
        best.setdefault(root(i), i)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies():
    chance = random.Random(4)
    pool = [f"v{k}" for k in range(60)]
    rows, passage = [], [f"p{k}" for k in range(25)]
    for d in range(150):
        if d % 3 and rows:
            words = chance.choice(rows[-12:])[1].split()
            for _ in range(chance.randint(0, 3)):
                words[chance.randrange(len(words))] = chance.choice(pool)
        else:
            words = [chance.choice(pool) for _ in range(chance.randint(3, 60))] + (passage if d % 2 else [])
        rows.append((d, " ".join(words)))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"hot": 3, "chunk_shingles": 100, "region_texts": 2}])
def test_components_equal_brute_force(spark, sizes):
    rows = near_copies()
    found = jaccard_join.joined(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, sig long"), **sizes).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)


def test_large_regions_are_cut_and_equal_brute_force(spark):
    """One region of many unlike texts that share rare shingles, with chains of near copies among them."""
    chance = random.Random(6)
    boiler = [[f"b{g}x{k}" for k in range(5)] for g in range(40)]  # a passage of one shingle each
    rows = []
    for d in range(900):
        if d % 3 == 2:
            words = chance.choice(rows[-9:])[1].split()
            for _ in range(chance.randint(0, 4)):
                words[chance.randrange(len(words))] = f"e{chance.randrange(10**6)}"
        else:
            words = [w for g in chance.sample(range(40), 9) for w in boiler[g]]
        rows.append((d, " ".join(words)))
    found = jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), region_texts=100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)


def test_a_cut_loses_no_link():
    """Pivots, homes and windows of one level: every linked pair is linked, or meets in a region."""
    import pyarrow as pa

    chance = random.Random(3)
    base = [[chance.randrange(400) for _ in range(24)] for _ in range(14)]
    sets = []
    for _ in range(160):
        own = set(chance.choice(base))
        for _ in range(chance.randint(0, 9)):
            own.discard(chance.choice(sorted(own)))
            own.add(chance.randrange(400))
        sets.append(own)
    sizes, shared = [len(s) for s in sets], [sorted(s) for s in sets]
    table = pa.table({"region": [1] * 160, "sig": list(range(160)), "n": pa.array(sizes, pa.int32()), "shared": pa.array(shared, pa.list_(pa.int64())), "group": list(range(160)), "home": [True] * 160})
    drawn = chance.sample(range(160), 20)
    out = jaccard_join.cut(table, table.take(drawn).drop(["home"]))
    joined, places = {(r["u"], r["v"]) for r in out.to_pylist() if r["u"] is not None}, defaultdict(set)
    for row in out.to_pylist():
        if row["u"] is None:
            places[row["sig"]].add((row["centre"], row["home"]))
    parent = list(range(160))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in joined:
        assert 100 * len(sets[u] & sets[v]) >= 75 * len(sets[u] | sets[v])
        parent[root(u)] = root(v)
    open_pairs = 0
    for a, b in itertools.combinations(range(160), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root(a) != root(b):
            open_pairs += 1
            assert not {a, b} & set(drawn)
            assert any((c, True) in places[a] and ({(c, True), (c, False)} & places[b]) or (c, True) in places[b] and (c, False) in places[a] for c, _ in places[a] | places[b])
    assert open_pairs and any(len(p) > 1 for p in places.values())


def test_join_on_odd_tables(odd, empty):
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.joined(odd).collect()), key=str)
    assert len(found) == len(ODD)
    by_id = {d: (n, c) for d, n, c in found}
    assert by_id[1] == (0, 1) and by_id[3] == (0, 3) and by_id[4] == (1, 4) and by_id[6] == (1, 5) and by_id[8] == (1, 8) and by_id[None] == (1, None)
    assert jaccard_join.joined(empty).count() == 0


def test_stars_equal_one_task(spark):
    chance = random.Random(8)
    edges = spark.createDataFrame([(chance.randint(0, 80), chance.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)], "a long, b long")
    one = {tuple(r) for r in components.components(edges).collect()}
    assert one == {tuple(r) for r in components.components(edges, one_task_edges=0).collect()}


# ---- line windows


def brute_lines(rows, size=3):
    seen, out = set(), {}
    places = []
    for i, text in rows:
        lines = text.split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip(" ")]
        places += [(tuple(lines[k].strip(" ") for k in solid[j : j + size]), i, solid[j : j + size]) for j in range(len(solid) - size + 1)]
        out[i] = [lines, set()]
    for window, i, at in places:
        if window in seen:
            out[i][1].update(at)
        seen.add(window)
    return {i: ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)) for i, (lines, gone) in out.items()}


def test_line_windows_equal_brute_force(spark):
    chance = random.Random(3)
    rows = [(d, "\n".join(chance.choice(["a", "b", " c ", "", "d", f"x{d}"]) for _ in range(chance.randint(1, 14)))) for d in range(60)]
    found = line_dedup.deduplicate(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words long"))
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in found.collect()} == brute_lines(rows)


def test_line_windows_on_odd_tables(odd, empty):
    found = {r["doc_id"]: r for r in line_dedup.deduplicate(odd).collect()}
    assert found[1]["text"] is None and found[1]["n_lines"] == 0 and found[2]["text"] == ""
    assert found[9]["text"] == "a b\n\nc d\ne f\nz" and found[9]["n_removed"] == 3
    assert line_dedup.deduplicate(odd).count() == len(ODD) and line_dedup.deduplicate(empty).count() == 0


# ---- statistics and rules


def test_statistics_equal_brute_force(spark, odd, empty, labels):
    chance = random.Random(9)
    texts = [" ".join(chance.choice(["a", "b", "c#", "d\n", "E"]) for _ in range(chance.randint(0, 40))) for _ in range(60)]
    for text in texts:
        words = text.split()
        at = defaultdict(list)
        for k in range(len(words) - 4):
            at[tuple(words[k : k + 5])].append(k)
        covered = {j for places in at.values() if len(places) > 1 for k in places for j in range(k, k + 5)}
        lines = [x for x in text.split("\n") if x.strip()]
        found = quality_rules.count_statistics(text)
        assert found[:5] == (len(words), sum(map(len, words)), text.count("#"), len(lines) - len(set(lines)), len(covered))
    rated = {r["doc_id"]: r for r in quality_rules.rated(odd, labels).collect()}
    assert rated[1]["n_words"] == 0 and rated[1]["base_failed"] and not rated[1]["kept"]
    assert rated[8]["n_repeat_words"] == 30_000 and not rated[8]["kept"]
    assert quality_rules.rated(empty, labels).count() == 0 and quality_rules.rated(odd, labels.where("false")).count() == len(ODD)


def test_rules_are_learnt_and_agree_with_their_expression(spark):
    chance = np.random.default_rng(0)
    columns = {name: chance.random(600) for name in quality_rules.features()}
    bad = (columns["symbol_share"] > 0.8) | ((columns["upper_share"] > 0.7) & (columns["mark_share"] > 0.6))
    rules = quality_rules.learn(columns, bad)
    rejected = np.zeros(600, bool)
    for rule in rules:
        rejected |= quality_rules.covered(rule, columns, 600)
    assert (rejected == bad).mean() > 0.97
    assert quality_rules.learn(columns, np.zeros(600, bool)) == []
    df = spark.createDataFrame([(12, 60, 30, 0, 0, 0, 0, 0, 9, 1), (0,) * 10], ", ".join(f"{c} long" for c in quality_rules.COUNTS))
    rule = [(quality_rules.Condition("symbol_share", True, 0.4),)]
    assert [r[0] for r in df.select(quality_rules.verdict(rule)).collect()] == [False, True]


# ---- models


def toy(n=240):
    chance = random.Random(12)
    plain, marked = ["the", "river", "stone", "walks", "slowly", "over", "green", "hills"], ["grubnax", "grubnole", "grubnit"]
    rows = []
    for d in range(n):
        words = [chance.choice(plain) + chance.choice(["", "s", "ed"]) for _ in range(chance.randint(5, 90))]
        y = int(d % 4 == 0)
        if y:
            begin = chance.randrange(len(words))
            words[begin:begin] = [chance.choice(marked) + chance.choice(["ly", "er", ""]) for _ in range(4)]
        rows.append((d, " ".join(words), y))
    return rows


def test_gradients_of_the_recurrent_network():
    net = toxicity.Network.fresh(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    chance = np.random.default_rng(0)
    x, mask, y, w = chance.standard_normal((4, 5, 16)), np.ones((4, 5)), np.array([1, 0, 1, 0.0]), np.array([1, 2, 1, 0.5])
    mask[1, 3:] = mask[2, 1:] = 0
    grads, dx, _ = net.gradients(x, mask, y, w)
    for name, values in net.p.items():
        at = tuple(chance.integers(0, s) for s in values.shape)
        old, ends = values[at], []
        for step in (1e-5, -1e-5):
            values[at] = old + step
            ends.append(net.gradients(x, mask, y, w)[2])
        values[at] = old
        assert abs((ends[0] - ends[1]) / 2e-5 - grads[name][at]) < 1e-6


def test_models_hold_on_rows_they_did_not_see(spark):
    rows = toy()
    documents = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1 - y, y) for d, _, y in rows], "doc_id long, quality int, toxic int")
    truth = {d: y for d, _, y in rows}
    toxic = [r for r in toxicity.scored(documents, labels).collect() if r["held_out"]]
    assert {r["doc_id"] for r in toxic} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in toxic) >= 0.9 * len(toxic)
    good = [r for r in quality_model.scored(documents, labels).collect() if r["held_out"]]
    assert {r["doc_id"] for r in good} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum((r["score"] >= 0.5) == (truth[r["doc_id"]] == 0) for r in good) >= 0.8 * len(good)


CLASHING = ["__lines", "n_lines", "__gone", "__kept", "__line_dedup_key", "text_id", "ids", "score", "sig", "region", "word", "row", "seed", "known", "y", "words", "held_out", "payload"]


def test_columns_of_clashing_names_do_no_harm(spark, odd, labels):
    """Every operator with extra columns that are named like its own."""
    def plain(df):
        return sorted(map(str, df.collect()))

    wide = odd
    for name in CLASHING:
        wide = wide.withColumn(name, F.lit("clash"))
    marks = labels.withColumn("y", F.lit("clash")).withColumn("text", F.lit("clash"))
    items = spark.createDataFrame([(1, "same words stand here twice")], "item_id long, text string")
    runs = {
        "op2": lambda d, m: toxicity.scored(d, m), "op3": lambda d, m: decontaminate.leaks(d, items.withColumn("text_id", F.lit("c"))), "op4": lambda d, m: lm_score.scored(d), "op5": lambda d, m: jaccard_join.joined(d),
        "op6": lambda d, m: token_files.written_and_read(d), "op7": lambda d, m: quality_model.scored(d, m), "op9": lambda d, m: bpe.round_trip_digests(d), "op10": lambda d, m: quality_rules.rated(d, m),
    }
    for name, run in runs.items():
        assert plain(run(wide, marks)) == plain(run(odd, labels)), name
    cut = line_dedup.deduplicate(wide)
    assert set(cut.columns) == {*wide.columns, "n_removed"}
    for row in cut.collect():
        assert all(row[name] == "clash" for name in CLASHING if name != "n_lines") and row["n_lines"] != "clash"


def test_two_labels_of_one_document_count_as_the_larger(spark):
    documents = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    for value, expected in ((1, [(1, "a", 1), (3, None, 1)]), (0, [(2, "c", 0)]), (None, [(1, "a", 1), (2, "c", 0), (3, None, 1)])):
        assert sorted(map(tuple, bounded_labelled_sample(documents, marks, "toxic", 9, only=value).collect())) == expected


def test_kept_equals_the_rules_applied_by_hand(spark):
    chance = random.Random(4)
    texts = [(d, " ".join(chance.choice(["alpha", "be#ta", "GAMMA", "d9", "e!"]) + str(d * 50 + k) for k in range(chance.randint(4, 40)))) for d in range(80)]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    rules = [(quality_rules.Condition("symbol_share", True, 0.03), quality_rules.Condition("upper_share", False, 0.2)), (quality_rules.Condition("words", False, 12.0),)]
    for row in quality_rules.apply(documents, rules).collect():
        words = dict(texts)[row["doc_id"]].split()
        chars, whole = sum(map(len, words)), " ".join(words)
        first = whole.count("#") / chars > 0.03 and sum(c.isupper() for c in whole) / chars <= 0.2
        assert row["base_failed"] == (len(words) < 10) and row["kept"] == (not row["base_failed"] and not first and len(words) > 12)


def test_scores_equal_a_loop_over_one_text_at_a_time(spark):
    """What the models give for many texts at once is what their formula gives for each alone."""
    rows = toy(60)
    documents = spark.createDataFrame([*((d, t) for d, t, _ in rows), (900, None), (901, "x" * 5000 + " stone")], "doc_id long, text string")
    texts = {**{d: t for d, t, _ in rows}, 900: "", 901: "x" * 5000 + " stone"}
    model = quality_model.train([t for _, t, _ in rows], np.array([1 - y for _, _, y in rows]), epochs=2)
    for row in quality_model.score(documents, model).collect():
        words = texts[row["doc_id"]].split()
        again = [quality_model.AGAIN] * sum(a == b for a, b in itertools.pairwise(words))
        scores = [float(model.word_scores([w])[0]) for w in words + again]
        mean = sum(scores) / len(scores) if scores else 0.0
        assert abs(row["score"] - 1 / (1 + math.exp(-(model.bias + mean)))) < 1e-5
    net = toxicity.train([t for _, t, _ in rows], np.array([y for _, _, y in rows]), epochs=2)
    for row in toxicity.score(documents, net).collect():
        words = toxicity.words_of(texts[row["doc_id"]])
        worst = -np.inf
        for start in toxicity.window_starts(len(words)):
            part = words[start : start + toxicity.WINDOW]
            x = net.network.inputs(toxicity.WordFeatures.of(part)) if part else np.zeros((0, 2 * toxicity.VECTOR), np.float32)
            worst = max(worst, float(net.document_logits(np.ascontiguousarray(x, np.float32), [len(part)])[0]))
        assert abs(row["score"] - 1 / (1 + math.exp(-worst))) < 1e-4


def test_models_on_odd_tables(odd, empty, labels):
    for module in (toxicity, quality_model):
        for marks in (labels, labels.where("false")):
            found = module.scored(odd, marks).collect()
            assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
            assert {r["held_out"] for r in found if r["doc_id"] is None} == {False}
        assert module.scored(empty, labels).count() == 0


def test_windows_overlap_and_cover():
    for n in (0, 1, 24, 25, 36, 37, 500):
        starts = list(toxicity.window_starts(n))
        assert starts[0] == 0 and starts[-1] + toxicity.WINDOW >= n
        assert all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def hashes_of(text):
    return Hasher().words(np.frombuffer(text.encode(), np.uint8))[0]


def test_pseudo_likelihood_equals_a_loop_and_learns(spark, odd, empty):
    chance = random.Random(7)
    rows = [(d, " ".join([*(w for _ in range(30) for w in chance.choice([("red", "fox"), ("blue", "sea"), ("old", "oak")])), f"once{d}", f"pair{d // 2}"])) for d in range(60)]
    rows += [(100 + k, " ".join(f"rare{k * 40 + j}" for j in range(60))) for k in range(60)]
    documents = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, word string, row int")
    counts = {}
    for _, text in rows:
        for word in text.split():
            counts[word] = counts.get(word, 0) + 1
    model = lm_score.fit(documents, rounds=4)
    words, net = model.words, lm_score.Network(model.weights.astype(np.float64))
    fresh = lm_score.Model(words, lm_score.Network.fresh(words).flat, model.counts)
    scores = {r["doc_id"]: r for r in lm_score.score(documents, model).collect()}
    assert sum(r["log_likelihood"] for r in scores.values()) > sum(r["log_likelihood"] for r in lm_score.score(documents, fresh).collect()) + 500
    # own words first, by falling count and then by hash; all others are one cell
    ranked = sorted(counts, key=lambda w: (-counts[w], int(hashes_of(w).view(np.int64)[0])))
    own, total = ranked[: lm_score.own_words(words.inputs)], sum(counts.values())
    assert len(own) < len(ranked)
    place, before, cells, mass = {}, 0, {}, {}
    rest = total - sum(counts[w] for w in own)
    for word, n in [*((w, counts[w]) for w in own), (None, rest)]:
        cells[word] = min(int((before + n / 2) / total * 4096), 4095)
        mass[cells[word]] = mass.get(cells[word], 0) + n
        before += n
    for d in (0, 7, 130):
        text, log = dict(rows)[d].split(), 0.0
        hashes = hashes_of(" ".join(text))
        inputs = words.inputs_of(hashes, words.places(hashes))
        for k, word in enumerate(text):
            around = np.concatenate([net.E[inputs[k + p] if 0 <= k + p < len(text) else 1] for p in lm_score.PLACES])
            h = np.tanh(around @ net.W + net.b)
            cell = cells[word if word in own else None]
            first, second = h @ net.O + net.c, h @ net.P[cell // 64] + net.d[cell // 64]
            share = counts[word] / mass[cell]
            log += first[cell // 64] - np.log(np.exp(first).sum()) + second[cell % 64] - np.log(np.exp(second).sum()) + np.log(share)
        assert scores[d]["n_tokens"] == len(text) and abs(scores[d]["log_likelihood"] - log) < 2e-2
    found = {r["doc_id"]: r for r in lm_score.scored(odd).collect()}
    assert found[1]["n_tokens"] == 0 and found[1]["log_likelihood"] == 0 and found[1]["mean_log_likelihood"] is None
    assert len(lm_score.scored(odd).collect()) == len(ODD) and lm_score.scored(empty).count() == 0


def test_gradients_of_the_window_network():
    chance = np.random.default_rng(0)
    words = lm_score.Words(np.arange(1, 200, dtype=np.uint64) << np.uint64(50), np.arange(199, 0, -1), 25_000, 4096)
    net = lm_score.Network(lm_score.Network.fresh(words).flat.astype(np.float64))
    around, cells = chance.integers(0, 40, (50, 4)), words.cell[chance.integers(0, 200, 50)]
    loss = lambda: -np.concatenate([net.forward(around, cells)[-1]]).astype(np.float64).mean()
    grads, met, moved = net.gradients(around, cells)
    times = np.bincount(around.reshape(-1), minlength=40)
    grads["E"] = np.zeros_like(net.E)
    grads["E"][met] = moved * times[met][:, None] / 50
    for name, grad in grads.items():
        values = getattr(net, name)
        for at in [tuple(chance.integers(0, s) for s in values.shape) if name != "E" else (int(chance.choice(met)), 3) for _ in range(4)]:
            old, ends = values[at], []
            for step in (1e-3, -1e-3):
                values[at] = old + step
                ends.append(loss())
            values[at] = old
            assert abs((ends[0] - ends[1]) / 2e-3 - grad[at]) < 2e-4, name


def test_training_equals_a_loop_and_does_not_depend_on_partitions(spark):
    chance = random.Random(9)
    rows = [(d, " ".join(chance.choice(["red", "fox", "blue", "sea", "old", f"w{d}"]) for _ in range(40))) for d in range(50)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    weights = [lm_score.fit(documents.repartition(n)).weights for n in (1, 7)]
    assert np.abs(weights[0] - weights[1]).max() < 1e-6
    # the one group's documents in the order of their hash, every word of each
    ordered = documents.selectExpr("text", "xxhash64(doc_id, text) AS h").orderBy("h", "text").collect()
    words = lm_score.choose_words(lm_score.count_words(documents))[0]
    net, squares = lm_score.Network.fresh(words), lm_score.Network(np.zeros_like(weights[0]))
    hashes = hashes_of(" ".join(r["text"] for r in ordered))
    places = words.places(hashes)
    net.step(lm_score.neighbours(words.inputs_of(hashes, places), np.full(50, 40)), words.cell[places], squares)
    assert np.abs(net.flat - weights[0]).max() < 1e-5


def test_lm_score_trains_on_words_at_every_place(spark):
    text = " ".join(["red", "fox", "blue", "sea"] * 40)
    model = lm_score.fit(spark.createDataFrame([(d, text) for d in range(400)], "doc_id long, text string"))
    hashes = hashes_of(text)
    places = model.words.places(hashes)
    around = lm_score.neighbours(model.words.inputs_of(hashes, places), np.array([len(hashes)]))
    fresh, trained = (lm_score.Network(w).log_probabilities(around, model.words.cell[places]) for w in (lm_score.Network.fresh(model.words).flat, model.weights))
    assert [k for k in range(4) if (trained - fresh)[k::4].mean() <= 0] == []


def test_lm_score_tables_grow_with_the_words(spark):
    rows = [(d, " ".join(f"often{k % 50} w{d}x{k}" for k in range(1500))) for d in range(200)]
    model = lm_score.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert model.counts.count() == 300_050 and model.words.inputs == lm_score.inputs_for(300_050) > lm_score.inputs_for(30_000)
    # a word never seen is rare, wherever it falls, and rare words are no single input
    unseen, often = hashes_of(" ".join(f"never{k}" for k in range(2000))), hashes_of(" ".join(f"often{k}" for k in range(50)))
    assert (model.words.places(unseen) == len(model.words.hashes) - 1).all() and (model.words.places(often) < len(model.words.hashes) - 1).all()
    assert len(set(model.words.inputs_of(unseen, model.words.places(unseen)).tolist())) > 1000
