"""Removal of repeated passages: overlapping windows of three consecutive lines.

Every window of three consecutive non-blank lines is hashed; a window that occurs more than
once in the corpus is kept at its first place, in order of (doc_id, line), and its later
occurrences cover their three lines.  Covered positions are merged and their lines removed.
DataFrame functions only: no Python code runs on the executors.

A third of all windows may be one window.  Occurrences are pre-aggregated to one row per
window before the shuffle, and the join back from windows to repeated windows reads the
latter from a stored table, so that adaptive execution can split a hot window's rows.

Defined cases: lines are compared without surrounding spaces; blank lines belong to no
window and stay; a text with fewer than three non-blank lines stays; a null text stays null
with no lines; a null doc_id orders first; rows that agree in doc_id and text are one
document in every place it stands; of equal windows the first in order of (doc_id, line) stays;
a very long text is cut like others; an empty table gives an empty result.  Input columns named
n_lines or n_removed are replaced by the counts; all others pass through unchanged, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 3

#: Columns of the windows, which hold none of the input's.
KEY, HASH_A, HASH_B, FIRST_LINE, LAST_LINE, COVER = (f"__line_dedup_{n}" for n in ("key", "a", "b", "from", "to", "cover"))


def document_key() -> Column:
    return F.struct(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.col("doc_id").isNotNull().alias("known"),
        F.xxhash64("text").alias("text"),
    )


def windows(documents: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per window: document key, 128 bits of hash, first and last line number."""
    lines = F.filter(
        F.transform(F.split("text", "\n", -1), lambda line, at: F.struct(at.alias("at"), F.trim(line).alias("line"))),
        lambda x: x["line"] != "",
    )

    def window(at: Column) -> Column:
        part = [F.col("lines")[at + k]["line"] for k in range(size)]
        return F.struct(
            F.xxhash64(*part).alias(HASH_A),
            F.xxhash64(F.lit(1), *reversed(part)).alias(HASH_B),
            F.col("lines")[at]["at"].alias(FIRST_LINE),
            F.col("lines")[at + (size - 1)]["at"].alias(LAST_LINE),
        )

    found = documents.select(document_key().alias(KEY), lines.alias("lines")).where(F.size("lines") >= size)
    starts = F.sequence(F.lit(0), F.size("lines") - size)
    return found.select(KEY, F.explode(F.transform(starts, window)).alias("w")).select(KEY, "w.*")


def repeated_windows(documents: DataFrame, size: int = WINDOW) -> DataFrame:
    """Windows that stand in more than one place, with the first of them."""
    place = F.struct(F.col(f"{KEY}.known"), F.col(f"{KEY}.id"), F.col(f"{KEY}.text"), F.col(FIRST_LINE))
    return (
        windows(documents, size)
        .groupBy(HASH_A, HASH_B)
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first <> last")
        .select(HASH_A, HASH_B, "first")
    )


def removals(documents: DataFrame, size: int = WINDOW) -> DataFrame:
    """(key, cover): the line ranges that later occurrences cover, per document."""
    repeated = stored(repeated_windows(documents, size), "repeated-windows")
    place = F.struct(F.col(f"{KEY}.known"), F.col(f"{KEY}.id"), F.col(f"{KEY}.text"), F.col(FIRST_LINE))
    later = windows(documents, size).join(repeated, [HASH_A, HASH_B]).where(place != F.col("first"))
    return later.groupBy(KEY).agg(F.collect_set(F.struct(FIRST_LINE, LAST_LINE)).alias(COVER))


def deduplicate(documents: DataFrame, size: int = WINDOW) -> DataFrame:
    """``documents`` with repeated passages cut from ``text``; adds n_lines and n_removed."""
    mark = "__line_dedup"
    while any(name.lower().startswith(mark) for name in documents.columns):
        mark += "_"
    key, cover, before, kept = (f"{mark}_{name}" for name in ("key", "cover", "before", "kept"))
    covered = removals(documents, size).withColumnsRenamed({KEY: key, COVER: cover}).hint("shuffle_hash")
    joined = documents.withColumn(key, document_key()).join(covered, key, "left")
    spans = F.array_distinct(F.flatten(F.transform(cover, lambda c: F.sequence(c[FIRST_LINE], c[LAST_LINE]))))
    # merged positions become flags by one pass over them, not a search per line
    gone = F.coalesce(F.map_from_arrays(spans, F.transform(spans, lambda _: F.lit(True))), F.create_map().cast("map<int,boolean>"))
    left = F.filter(
        F.transform(F.col(before)["lines"], lambda line, at: F.struct(at.alias("at"), line.alias("line"))),
        lambda x: ~F.coalesce(F.try_element_at(F.col(before)["gone"], x["at"]), F.lit(False)) | (F.trim(x["line"]) == ""),
    )
    flagged = joined.withColumn(before, F.struct(F.split("text", "\n", -1).alias("lines"), gone.alias("gone")))
    result = flagged.withColumn(kept, F.when(F.col(cover).isNull(), F.col(before)["lines"]).otherwise(F.transform(left, lambda x: x["line"])))
    return result.withColumns(
        {
            "text": F.when(F.col(cover).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
            "n_lines": F.coalesce(F.size(F.col(before)["lines"]), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size(F.col(before)["lines"]) - F.size(kept), F.lit(0)).cast("long"),
        }
    ).drop(key, cover, before, kept)


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL
), solid AS (
  SELECT doc_id, pos, row_number() OVER w AS nth, trim(line, ' ') AS a,
         lead(trim(line, ' '), 1) OVER w AS b, lead(trim(line, ' '), 2) OVER w AS c
  FROM lines WHERE trim(line, ' ') <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, nth, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, nth) AS occurrence
  FROM solid WHERE c IS NOT NULL
), gone AS (
  SELECT DISTINCT s.doc_id, s.pos FROM ranked r JOIN solid s ON s.doc_id = r.doc_id AND s.nth BETWEEN r.nth AND r.nth + 2
  WHERE r.occurrence > 1
), kept AS (
  SELECT l.doc_id, string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS text,
         count(*) AS n_lines, count(g.pos) AS n_removed
  FROM lines l LEFT JOIN gone g USING (doc_id, pos) GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
