"""Readers of feeds, sitemaps and listings: rows, bad files, pushed filters, streams that go on."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from attestry.sources import connectors

RSS = "<rss><channel><item><title>{0} &amp; x</title><link>https://a.vn/{0}</link><pubDate>2026-07-01</pubDate></item><item><title>no link</title></item></channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Atom</title><link rel="self" href="no"/><link href="https://b.vn/1"/><updated>2026-01-02</updated></entry></feed>'
MAP = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://c.vn/en/new-rider_plan/ </loc><lastmod>2026-02-03</lastmod></url><url><lastmod>x</lastmod></url><url><loc>https://c.vn</loc></url></urlset>'
LIST = json.dumps({"data": [{"id": 1, "title": " T ", "date": "2026-03-04"}, {"id": None, "title": "x"}, {"id": 2, "title": " "}, {"id": 3, "title": "U", "url": "https://d.vn/3"}]})


def put(folder, name, *lines):
    (folder / name).write_bytes("\n".join(lines).encode())


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def read(spark):
    connectors.register(spark)
    return lambda kind, folder, **options: spark.read.format(f"attestry_{kind}").options(**options).load(f"file://{folder}")


def test_items_of_each_kind(read, tmp_path):
    for kind, text in (("feed", RSS.format("1")), ("sitemap", MAP), ("listing", LIST)):
        (tmp_path / kind).mkdir()
        put(tmp_path / kind, "a.txt", text, "", *([ATOM] if kind == "feed" else []))
    assert rows(read("feed", tmp_path / "feed")) == [("a.txt", 0, 0, "1 & x", "https://a.vn/1", "2026-07-01", None), ("a.txt", 0, 1, "no link", None, None, None), ("a.txt", 2, 0, "Atom", "https://b.vn/1", "2026-01-02", None)]
    assert rows(read("sitemap", tmp_path / "sitemap")) == [("a.txt", 0, 0, "New Rider Plan", "https://c.vn/en/new-rider_plan/", "2026-02-03", None), ("a.txt", 0, 1, None, "https://c.vn", None, None)]
    assert rows(read("listing", tmp_path / "listing")) == [("a.txt", 0, 0, "T", "1", "2026-03-04", None), ("a.txt", 0, 1, "U", "https://d.vn/3", None, None)]


def test_what_cannot_be_read_becomes_a_row(read, tmp_path):
    put(tmp_path, "a.txt", RSS.format("1")[:-5], RSS.format("2"), "no xml", "<rss/>")
    (tmp_path / "b.txt").write_bytes(gzip.compress(b"x" * 100))
    put(tmp_path, "_SUCCESS", "x")
    put(tmp_path, ".hidden", "x")
    put(tmp_path, "empty")
    found = rows(read("feed", tmp_path))
    assert [(r[0], r[1], r[6]) for r in found if r[6]] == [("a.txt", 0, "PARSE_ERROR"), ("a.txt", 2, "PARSE_ERROR"), ("b.txt", None, "UNREADABLE")] and len(found) == 5
    (tmp_path / "list").mkdir()
    put(tmp_path / "list", "a", "[]", "{}", '{"data": null}', '{"data": [1]}', '{"data": []}', LIST)
    assert [r[6] for r in rows(read("listing", tmp_path / "list"))].count("PARSE_ERROR") == 4
    (tmp_path / "none").mkdir()
    assert rows(read("feed", tmp_path / "none")) == [] and rows(read("feed", tmp_path / "missing")) == []


def test_files_are_dealt_by_bytes_and_filters_reach_the_reader(read, tmp_path):
    for k in range(10):
        put(tmp_path, f"f{k}", RSS.format(k))
    assert read("feed", tmp_path).rdd.getNumPartitions() == 1 and read("feed", tmp_path, bytesPerTask="300").rdd.getNumPartitions() == 10
    for only in (F.col("file") == "f3", F.col("file").isin("f3"), (F.col("file") == "f3") & (F.col("file").isin("f3", "f4"))):
        df = read("feed", tmp_path, bytesPerTask="300").where(only & F.contains("link", F.lit("a.vn")))
        assert [r[:3] for r in rows(df)] == [("f3", 0, 0)] and df.rdd.getNumPartitions() == 1
    assert rows(read("feed", tmp_path).where((F.col("file") == "f3") & (F.col("file") == "f4"))) == []
    assert len(rows(read("feed", tmp_path).where(F.contains("link", F.lit("/7"))))) == 1 and len(rows(read("feed", tmp_path).where("link is null"))) == 10


def test_a_stream_started_again_gives_no_row_twice(spark, read, tmp_path):
    folder, out, mark = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    folder.mkdir()

    def run():
        stream = spark.readStream.format("attestry_feed").load(f"file://{folder}")
        stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r["file"], str(r["pos"])) for r in spark.read.schema(stream.schema).parquet(out).collect())

    put(folder, "f1", RSS.format(1))
    put(folder, "f2", "broken")
    assert run() == [("f1", "0"), ("f1", "1"), ("f2", "None")]
    put(folder, "f3", RSS.format(3))
    assert run() == [("f1", "0"), ("f1", "1"), ("f2", "None"), ("f3", "0"), ("f3", "1")]
    assert len(run()) == 5
