"""Votes, labels and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import classifications, documents, routing, votes, with_tables
from ..domains import DEPARTMENTS
from ..operators.relational import rank_limited

LABELS = ("click", "view", "purchase")


def majority(spark: SparkSession, sf_dir: str, samples: int = 3, least: int = 2) -> DataFrame:
    """Labels with enough votes among the samples of a document, and the document's status."""
    cast = votes(spark, sf_dir).where(F.col("label").isin(*LABELS)).distinct()
    runs = votes(spark, sf_dir).groupBy("doc_id").agg(F.count_distinct("sample").alias("valid"))
    kept = cast.groupBy("doc_id", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    labels = kept.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    status = F.when(F.col("valid") < min(2, samples), "UNCERTAIN").when(F.coalesce("labels", F.lit("")) != "", "CONFIRMED").otherwise("NO_LABEL_REVIEW")
    return runs.join(labels, "doc_id", "left").select("doc_id", "valid", F.coalesce("labels", F.lit("")).alias("labels"), status.alias("status"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departments of every classified document; a category without a rule goes to the admins."""
    cls = classifications(spark, sf_dir)
    rules = routing(spark).withColumnRenamed("category", "label")
    found = cls.where("status = 'CONFIRMED'").select("doc_id", F.explode("labels").alias("label")).join(F.broadcast(rules), "label", "left")
    by_doc = found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("department")), ",").alias("departments"), F.bool_or(F.col("department").isNull()).alias("open"))
    state = F.when(F.col("status") != "CONFIRMED", "HELD_FOR_REVIEW").when(F.col("open"), "ADMIN_QUEUE").otherwise("ROUTED")
    return cls.join(by_doc, "doc_id", "left").select("doc_id", F.coalesce("departments", F.lit("")).alias("departments"), state.alias("routing"))


def by_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per department: documents, those of the last week, and the first three by id."""
    docs = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "fetched_at")
    each = routed(spark, sf_dir).where("departments <> ''").select("doc_id", F.explode(F.split("departments", ",")).alias("department")).join(docs, "doc_id")
    counts = each.groupBy("department").agg(F.count("*").alias("n"), F.count_if(F.col("fetched_at") > F.lit("2026-07-30").cast("timestamp")).alias("week"))
    heads = rank_limited(each, ["department"], [F.col("doc_id")], 3).groupBy("department").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("top"))
    domain = spark.createDataFrame([(d,) for d in DEPARTMENTS], "department string")
    zero = domain.join(counts, "department", "left").join(heads, "department", "left")
    return zero.select("department", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("week", F.lit(0)).alias("week"), F.coalesce("top", F.lit("")).alias("top"))


def backfilled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose routing changes when every category without a rule gets STRATEGY."""
    have = routing(spark).select(F.col("category").alias("label")).distinct()
    each = classifications(spark, sf_dir).where("status = 'CONFIRMED'").select("doc_id", F.explode("labels").alias("label"))
    return each.join(F.broadcast(have), "label", "left_anti").groupBy("label").agg(F.count_distinct("doc_id").alias("rerouted"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifications(spark, sf_dir).select("status", F.explode("labels").alias("label")).groupBy("label", "status").agg(F.count("*").alias("n"))


def with_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = classifications(spark, sf_dir).where(F.array_contains("labels", "PRODUCT_LAUNCH") & (F.col("status") == "CONFIRMED"))
    return kept.select("doc_id", F.array_join("labels", ",").alias("labels"))


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of a document in each sample of votes, only where all votes of the sample agree."""
    g = votes(spark, sf_dir).groupBy("doc_id", "sample").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return g.select("doc_id", "sample", F.when(F.size("labels") == 1, F.element_at("labels", 1)).alias("label"), F.size("labels").alias("n"))


QUERIES = {
    "f04_majority_vote": majority, "d06_routing": routed, "f23_department_overview": by_department, "e15_rule_backfill": backfilled_rules,
    "f02_label_counts": label_counts, "d05_by_label": with_label, "f34_label_consensus": consensus,
}

_ROUTED = """SELECT c.doc_id, coalesce(departments, '') AS departments, CASE WHEN status <> 'CONFIRMED' THEN 'HELD_FOR_REVIEW' WHEN open THEN 'ADMIN_QUEUE' ELSE 'ROUTED' END AS routing FROM cls c LEFT JOIN
  (SELECT doc_id, string_agg(DISTINCT department, ',' ORDER BY department) AS departments, bool_or(department IS NULL) AS open FROM (SELECT doc_id, unnest(labels) AS label FROM cls WHERE status = 'CONFIRMED') LEFT JOIN rules ON category = label GROUP BY doc_id) r ON r.doc_id = c.doc_id"""
ORACLE_SQL = {
    "f04_majority_vote": with_tables("votes", """SELECT r.doc_id, valid, coalesce(labels, '') AS labels, CASE WHEN valid < 2 THEN 'UNCERTAIN' WHEN labels IS NOT NULL THEN 'CONFIRMED' ELSE 'NO_LABEL_REVIEW' END AS status
      FROM (SELECT doc_id, count(DISTINCT sample) AS valid FROM votes GROUP BY doc_id) r LEFT JOIN (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM
      (SELECT doc_id, label FROM votes WHERE label IN ('click', 'view', 'purchase') GROUP BY ALL HAVING count(DISTINCT sample) >= 2) GROUP BY doc_id) k ON k.doc_id = r.doc_id"""),
    "d06_routing": with_tables("cls rules", _ROUTED),
    "f23_department_overview": with_tables("docs cls rules", f"""SELECT department, count(doc_id) AS n, count(*) FILTER (fetched_at > TIMESTAMP '2026-07-30') AS week, coalesce(string_agg(CASE WHEN rn <= 3 THEN CAST(doc_id AS VARCHAR) END, ',' ORDER BY doc_id), '') AS top
      FROM (SELECT d AS department, x.doc_id, fetched_at, row_number() OVER (PARTITION BY d ORDER BY x.doc_id) AS rn FROM (SELECT unnest(['STRATEGY', 'PRODUCT', 'SALES', 'COMPLIANCE']) AS d)
      LEFT JOIN (SELECT doc_id, unnest(string_split(departments, ',')) AS dep FROM ({_ROUTED}) WHERE departments <> '') x ON dep = d LEFT JOIN docs ON id = x.doc_id) GROUP BY department"""),
    "e15_rule_backfill": with_tables("cls rules", "SELECT label, count(DISTINCT doc_id) AS rerouted FROM (SELECT doc_id, unnest(labels) AS label FROM cls WHERE status = 'CONFIRMED') WHERE label NOT IN (SELECT category FROM rules) GROUP BY label"),
    "f02_label_counts": with_tables("cls", "SELECT label, status, count(*) AS n FROM (SELECT status, unnest(labels) AS label FROM cls) GROUP BY ALL"),
    "d05_by_label": with_tables("cls", "SELECT doc_id, array_to_string(labels, ',') AS labels FROM cls WHERE list_contains(labels, 'PRODUCT_LAUNCH') AND status = 'CONFIRMED'"),
    "f34_label_consensus": with_tables("votes", "SELECT doc_id, sample, CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS label, CAST(count(DISTINCT label) AS INT) AS n FROM votes GROUP BY ALL"),
}
