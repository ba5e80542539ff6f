"""Every query with SQL gives the rows of that SQL on the small tables, and runs on empty and rough ones."""

import datetime
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.sql import functions as F

from attestry import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
USED = "orders lineitem events documents pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def answers(spark, folder):
    """(columns, rows) or the error of every query; some run at a time."""

    def ask(name):
        try:
            found = catalog.QUERIES[name](spark, folder)
            return found.columns, found.collect()
        except Exception as problem:
            return problem

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(catalog.QUERIES, pool.map(ask, catalog.QUERIES), strict=True))


@pytest.fixture(scope="module")
def found(spark):
    return answers(spark, FOLDER)


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if isinstance(value, (datetime.date, datetime.datetime)) else value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(found, duck, name):
    if isinstance(found[name], Exception):
        raise found[name]
    columns, rows = found[name]
    columns = sorted(columns)
    answer = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    expected = [tuple(plain(row[names.index(c)]) for c in columns) for row in answer.fetchall()]
    assert ordered(tuple(plain(r[c]) for c in columns) for r in rows) == ordered(expected)


#: Sequential selections, complete-link groups and a page cleaner; held by tests/test_selection.py.
WITHOUT_SQL = {"g08_analyst_batch", "d18_stories", "a11_reader_articles"}


def test_all_other_queries_have_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == WITHOUT_SQL


def test_every_query_runs_on_empty_tables(spark, tmp_path):
    for name in USED:
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"file://{tmp_path}/{name}.parquet")
    problems = {n: str(a)[:300] for n, a in answers(spark, f"file://{tmp_path}").items() if isinstance(a, Exception)}
    assert problems == {}


#: Columns that some rows of the rough tables lack.
GAPS = {"documents": ("text", "lang"), "benchmark": ("text",), "labels": ("toxic", "quality"), "pages": ("url", "html"), "conversations": ("text", "role"), "events": ("value", "ts"), "orders": ("o_orderdate", "o_orderpriority"), "lineitem": ("l_shipdate", "l_returnflag")}


def test_every_query_runs_on_rough_tables(spark, tmp_path):
    """Nulls, empty texts, ties and repeated rows crash nothing."""
    for name in USED:
        rows = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        key = rows.columns[0]
        for k, column in enumerate(GAPS[name]):
            rows = rows.withColumn(column, F.when(F.pmod(F.xxhash64(key, F.lit(k)), F.lit(7)) > 0, F.col(column)))
        if name == "documents":
            rows = rows.withColumn("text", F.when(F.col("doc_id") % 9 == 4, "").otherwise(F.col("text")))
        rows.unionByName(rows.where(F.col(key) % 5 == 0)).coalesce(1).write.parquet(f"file://{tmp_path}/{name}.parquet")
    problems = {n: str(a)[:300] for n, a in answers(spark, f"file://{tmp_path}").items() if isinstance(a, Exception)}
    assert problems == {}
