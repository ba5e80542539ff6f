"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import documents, table, with_tables
from ..functions import text

def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", text.normal_title(F.col("title")).alias("title"), F.size(text.word_set(text.normal_title(F.col("title")))).alias("n_words"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = text.thirds(F.col("text"), 1800, 600)
    cut = text.cut_after(F.col("title"), 40)
    return documents(spark, sf_dir).select("id", F.sha2(short, 256).alias("excerpt_sha"), cut.alias("cut_after"), text.cut_within(F.col("title"), 40).alias("cut_within"))


def word_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a term as a word, against those that hold it anywhere."""
    docs = documents(spark, sf_dir).select("lang", "text")
    return docs.groupBy("lang").agg(F.count_if(text.has_word(F.col("text"), "license")).alias("as_word"), F.count_if(F.lower("text").contains("license")).alias("anywhere"))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.number_tokens(F.col("text"))
    return documents(spark, sf_dir).select("id", F.array_join(found, " ").alias("numbers"), F.size(found).alias("n")).where("n > 0")


def code_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes cited in a list, those that exist, and what is missing."""
    docs = documents(spark, sf_dir).select("id", F.concat_ws(" , ", F.col("id").cast("string"), F.lit(" "), (F.col("id") * 3).cast("string"), F.lit("")).alias("cited"))
    cited = docs.select("id", F.explode(text.codes(F.col("cited"))).alias("code"))
    known = documents(spark, sf_dir).select(F.col("id").cast("string").alias("code"), F.lit(True).alias("known"))
    g = cited.join(known, "code", "left").groupBy("id").agg(F.count_if("known").alias("resolved"), F.count_if(F.col("known").isNull()).alias("missing"))
    return g.withColumn("complete", F.col("missing") == 0)


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.concat_ws("\n", F.lit("pipeline-3"), F.lit("model-a"), F.lit("prompt-1"), "content_hash")
    return documents(spark, sf_dir).select("id", F.sha2(lines, 256).alias("signature"))


def fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in a code fence read back as the JSON inside, by role."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct("role", "turn")), F.lit("\n```"))
    return turns.select("conv_id", "turn", F.get_json_object(text.without_fence(reply), "$.role").alias("role"))


def labels_of_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^/?#]*)", 1).alias("slug"))
    return urls.select("page_id", text.slug_label(F.col("slug")).alias("label"), text.key_of_label(F.col("slug")).alias("key"))


QUERIES = {
    "k01_normal_titles": titles, "k18_excerpts": excerpts, "k21_word_match": word_hits, "k05_number_tokens": numbers,
    "d20_citation_resolution": code_lists, "e07_signatures": signatures, "k23_fenced_json": fences, "k47_slug_labels": labels_of_slugs,
}

ORACLE_SQL = {
    "k01_normal_titles": with_tables("docs", "SELECT id, t AS title, CAST(len(list_distinct(list_filter(string_split(t, ' '), lambda w: w <> ''))) AS INT) AS n_words FROM (SELECT id, trim(regexp_replace(lower(title), '[^\\p{L}\\p{Nd}]+', ' ', 'g'), ' ') AS t FROM docs)"),
    "k18_excerpts": with_tables("docs", """SELECT id, sha256(CASE WHEN length(text) > 1800 THEN substr(text, 1, 600) || chr(10) || '…' || chr(10) || substr(text, CAST(floor((length(text) - 600) / 2) AS BIGINT) + 1, 600) || chr(10) || '…' || chr(10) || right(text, 600) ELSE text END) AS excerpt_sha,
      CASE WHEN length(title) > 40 THEN substr(title, 1, 40) || '…' ELSE title END AS cut_after, CASE WHEN length(title) > 40 THEN substr(title, 1, 39) || '…' ELSE title END AS cut_within FROM docs"""),
    "k21_word_match": with_tables("docs", "SELECT lang, count(*) FILTER (regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])license($|[^\\p{L}\\p{N}])')) AS as_word, count(*) FILTER (contains(lower(text), 'license')) AS anywhere FROM docs GROUP BY lang"),
    "k05_number_tokens": with_tables("docs", """SELECT id, array_to_string(x, ' ') AS numbers, CAST(len(x) AS INT) AS n FROM (SELECT id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)*\\s*%?)', 1), lambda t: regexp_replace(t, '\\s+', '', 'g')))) AS x FROM docs) WHERE len(x) > 0"""),
    "d20_citation_resolution": with_tables("docs", "SELECT id, count(k) AS resolved, count(*) - count(k) AS missing, count(*) = count(k) AS complete FROM (SELECT d.id, e.id AS k FROM (SELECT id, unnest([id, id * 3]) AS c FROM docs) d LEFT JOIN docs e ON e.id = c) GROUP BY id"),
    "e07_signatures": with_tables("docs", "SELECT id, sha256(concat_ws(chr(10), 'pipeline-3', 'model-a', 'prompt-1', content_hash)) AS signature FROM docs"),
    "k23_fenced_json": "SELECT conv_id, turn, role FROM conversations",
    "k47_slug_labels": """SELECT page_id, CASE WHEN regexp_full_match(slug, '[a-z0-9]+([-_][a-z0-9]+)*') THEN array_to_string(list_transform(string_split(regexp_replace(slug, '[-_]', ' ', 'g'), ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ') ELSE slug END AS label,
      substr(trim(regexp_replace(upper(slug), '[^A-Z0-9]+', '_', 'g'), '_'), 1, 32) AS key FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1) AS slug FROM pages)""",
}
