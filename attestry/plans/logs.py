"""Run and item logs: as-of joins, trails, sessions and recent rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import item_log, run_log, table, with_tables
from ..operators.relational import as_of, latest

STAGES = ("view", "click", "purchase", "error")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the latest run that had started by then; 0 before the first."""
    found = as_of(item_log(spark, sf_dir).select("item_id", "created"), run_log(spark, sf_dir), "created", "started", "run_id")
    return found.select("item_id", F.coalesce("run_id", F.lit(0)).alias("run_id"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = as_of(item_log(spark, sf_dir).select("item_id", "doc_id", "created", "status"), run_log(spark, sf_dir), "created", "started", "run_id")
    return joined.groupBy(F.coalesce("run_id", F.lit(0)).alias("run_id")).agg(F.count("*").alias("items"), F.count_distinct("doc_id").alias("docs"), F.count_if(F.col("status") == "ERROR").alias("errors"))


def trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses per document and stage side by side."""
    wide = item_log(spark, sf_dir).groupBy("doc_id").pivot("stage", list(STAGES)).agg(F.array_join(F.array_sort(F.collect_set("status")), ", "))
    return wide.select("doc_id", *(F.coalesce(F.nullif(F.col(s), F.lit("")), F.lit("NOT_PROCESSED")).alias(s) for s in STAGES))


def last_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(item_log(spark, sf_dir), ["doc_id", "stage"], ["created", "item_id"], ["status", "item_id"])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = item_log(spark, sf_dir).groupBy("stage", F.to_date("created").alias("day"))
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "OK").alias("ok"), F.min("created").alias("first_at"), F.max("created").alias("last_at"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of one document with less than two hours between them."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("at"))
    g = e.groupBy("doc_id", F.session_window("at", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("doc_id", F.col("w.start").alias("begin"), "n")


def failure_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed items by the channel named in their properties, as one summary per stage."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    keys = F.get_json_object("props", "$.k").cast("long") % 5
    g = e.groupBy(F.coalesce(keys, F.lit(-1)).alias("code")).agg(F.count("*").alias("n"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("code", "n"))), lambda x: F.concat_ws("=", x["code"], x["n"]))
    return g.agg(F.array_join(line, ",").alias("summary"), F.sum("n").alias("n"))


QUERIES = {"d19_as_of_batch": batches, "f24_feed_by_batch": feed, "f22_pipeline_trail": trail, "g02_last_status": last_status, "f09_daily_counts": daily, "j12_sessions": sessions, "f29_failure_summary": failure_codes}

ORACLE_SQL = {
    "d19_as_of_batch": with_tables("items runs", "SELECT item_id, coalesce(run_id, 0) AS run_id FROM items ASOF LEFT JOIN runs ON started <= created"),
    "f24_feed_by_batch": with_tables("items runs", "SELECT coalesce(run_id, 0) AS run_id, count(*) AS items, count(DISTINCT doc_id) AS docs, count(*) FILTER (status = 'ERROR') AS errors FROM items ASOF LEFT JOIN runs ON started <= created GROUP BY ALL"),
    "f22_pipeline_trail": with_tables("items", "SELECT doc_id, " + ", ".join(f"coalesce(string_agg(DISTINCT CASE WHEN stage = '{s}' THEN status END, ', ' ORDER BY CASE WHEN stage = '{s}' THEN status END), 'NOT_PROCESSED') AS {s}" for s in STAGES) + " FROM items GROUP BY doc_id"),
    "g02_last_status": with_tables("items", "SELECT doc_id, stage, status, item_id FROM items QUALIFY row_number() OVER (PARTITION BY doc_id, stage ORDER BY created DESC, item_id DESC) = 1"),
    "f09_daily_counts": with_tables("items", "SELECT stage, CAST(created AS DATE) AS day, count(*) AS n, count(*) FILTER (status = 'OK') AS ok, min(created) AS first_at, max(created) AS last_at FROM items GROUP BY ALL"),
    "j12_sessions": """SELECT doc_id, begin, n FROM (SELECT doc_id, grp, min(ts) AS begin, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT user_id AS doc_id, ts, event_id,
      CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY doc_id, grp)""",
    "f29_failure_summary": "SELECT string_agg(code || '=' || n, ',' ORDER BY code) AS summary, CAST(sum(n) AS BIGINT) AS n FROM (SELECT coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5, -1) AS code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL)",
}
