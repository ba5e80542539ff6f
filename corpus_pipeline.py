"""The corpus pipeline: stages over documents, each written and read again by the runner.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return
the columns of documents; the last returns the token digests of what is left.

Defined cases: a null or empty text fails the base rule and goes; a doc_id names one document,
so rows that share an id, or have none, are judged together: they stay if one of them passes
the rules, go if one of them leaks, and stay or go as one in the near-duplicate stage; very
long texts are judged whole; other columns than those of documents
are dropped, whatever their names; an empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from attestry.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def only_kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose id is in ``kept``; documents without an id are judged too."""
    ids = kept.select(F.col("doc_id").alias("__kept")).distinct()
    return docs.select(*COLUMNS).join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("__kept")), "left_semi")


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go."""
    rated = quality_rules.rated(docs, table(spark, sf_dir, "labels"))
    return only_kept(docs, rated.where("kept"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line passages go from the texts."""
    cut = line_dedup.deduplicate(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    groups = jaccard_join.joined(docs)
    return only_kept(docs, groups.where("doc_id <=> component_id"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    return bpe.round_trip_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules_stage),
    ("line_dedup", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", benchmark_stage),
    ("bpe", tokens_stage),
]

#: Learned rules, spaced seeds and BPE have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
