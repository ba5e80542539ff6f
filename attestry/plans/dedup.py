"""Duplicate detection between documents: pairs, verdicts, winners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..bindings import documents, sources, with_tables
from ..functions import text
from ..operators.banded import banded_links, hashed, once, set_pairs, trigram_sets
from ..operators.relational import all_token_pairs, token_pairs

CONTENT_NEAR, BAND_HOURS = 0.92, 72


def title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal titles through a representative, and pairs of representatives that are near."""
    docs = documents(spark, sf_dir).select("id", text.word_set(text.normal_title(F.col("title"))).alias("words"))
    return token_pairs(docs, "id", "words", 0.8).select("a", "b", F.round("overlap", 6).alias("overlap"))


def content_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two documents alike in their word trigrams, copies of one text with each other and with all that is near to it."""
    words = F.array_remove(F.split(text.normal_title(F.col("text")), " "), "")
    return all_token_pairs(trigram_sets(documents(spark, sf_dir).select("id", "text"), "grams", words), "id", "grams", CONTENT_NEAR).select("a", "b", F.round("overlap", 6).alias("overlap"))


def banded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of one content that were seen within 72 hours of each other, with verdict and winner.

    Each copy is linked with the one before it, so a group of n copies gives n - 1 rows at
    most and every two copies within 72 hours are joined through the rows between them.  A
    band of 72 hours sorts its own copies; the first one looks back to the last of the band
    before, so no content is one task.
    """
    docs = documents(spark, sf_dir).select("id", "source_code", "content_hash", F.coalesce("published_at", "fetched_at").alias("at"))
    docs = docs.join(sources(spark, sf_dir).select(F.col("code").alias("source_code"), "authority_score"), "source_code")
    band = F.floor(F.unix_timestamp("at") / (BAND_HOURS * 3600))
    rows = docs.select("content_hash", band.alias("band"), F.struct("at", "id", "authority_score").alias("x"))
    ends = rows.groupBy("content_hash", "band").agg(F.max("x").alias("last")).select("content_hash", (F.col("band") + 1).alias("band"), "last")
    own = F.lag("x").over(Window.partitionBy("content_hash", "band").orderBy("x.at", "x.id"))
    pairs = rows.withColumn("own", own).join(ends, ["content_hash", "band"], "left").select("x", F.coalesce("own", "last").alias("h"))
    met = pairs.where(F.col("h").isNotNull() & (F.unix_timestamp("x.at") - F.unix_timestamp("h.at") <= BAND_HOURS * 3600))
    wins = (
        F.when(F.col("x.authority_score") > F.col("h.authority_score"), F.col("x.id")).when(F.col("x.authority_score") < F.col("h.authority_score"), F.col("h.id"))
        .when(F.col("x.at") > F.col("h.at"), F.col("x.id")).otherwise(F.least("x.id", "h.id"))
    )
    return met.select(F.least("x.id", "h.id").alias("a"), F.greatest("x.id", "h.id").alias("b"), F.lit("DUPLICATE_CONTENT").alias("verdict"), wins.alias("winner"))


def losers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the copy that stands for it: highest authority, then the newest, then the smallest id."""
    docs = documents(spark, sf_dir).select("id", "source_code", "content_hash", F.coalesce("published_at", "fetched_at").alias("at"))
    docs = docs.join(sources(spark, sf_dir).select(F.col("code").alias("source_code"), "authority_score"), "source_code")
    best = docs.groupBy("content_hash").agg(F.max_by("id", F.struct("authority_score", "at", (-F.col("id")).alias("i"))).alias("winner"), F.count("*").alias("n")).where("n > 1").select("content_hash", "winner")
    return docs.join(best, "content_hash").where("id <> winner").select("id", F.col("winner").alias("duplicate_of"))


def class_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Near pairs of (id, w): rows of one set with its first row, and the first rows with each other."""
    members, pairs = set_pairs(sets, "id", "w", percent)
    return pairs.unionByName(members.where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"), F.lit(1.0).alias("overlap")))


def pair_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder of verdicts over parsed documents seen within 72 hours of each other.

    The first rung that holds decides: equal address, equal content, texts alike in 92 % of
    their word trigrams, else titles alike in half of their words, which only a person or a
    model can judge.  Copies are decided for the better authority, then for the newer of two
    dated ones, else left to review.  Pairs are the links of :func:`banded_links`: of n copies,
    or of a document and n copies of another, not every two have a row, but all are joined
    through rows.  Pairs without a row differ.
    """
    src = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "authority_score")
    docs = documents(spark, sf_dir).where("parse_status = 'OK'").join(src, "source_code")
    rows = docs.select("id", F.unix_timestamp(F.coalesce("published_at", "fetched_at")).alias("at"), "url", "content_hash", "authority_score", "published_at", "title", "text")
    rows = once(rows, "title", hashed(text.word_set(text.normal_title(F.col("title")))))
    rows = trigram_sets(rows, "content", F.array_remove(F.split(text.normal_title(F.col("text")), " "), "")).drop("text")
    links = banded_links(rows, BAND_HOURS * 3600, ["url", "content_hash"], {"title": 50, "content": 92}, beside=("authority_score", "published_at"))
    method = F.when(F.col("same_url"), "EXACT_URL").when(F.col("same_content_hash"), "EXACT_HASH").when(F.col("content").isNotNull(), "JACCARD_TITLE").otherwise("LLM_PAIRWISE")
    score_a, score_b, day_a, day_b = (F.col(f"{k}_{c}") for c in ("authority_score", "published_at") for k in "ab")
    better = F.when(score_a > score_b, F.col("a")).when(score_a < score_b, F.col("b")).when(day_a > day_b, F.col("a")).when(day_a < day_b, F.col("b"))
    judged = links.withColumn("method", method).withColumn("winner", F.when(F.col("method") != "LLM_PAIRWISE", better))
    verdict = F.when(F.col("winner").isNotNull(), "DUPLICATE_CONTENT").otherwise("NEEDS_REVIEW")
    return judged.select("a", "b", "method", verdict.alias("verdict"), "winner", F.round("title", 6).alias("title_overlap"), F.round("content", 6).alias("content_overlap"))


QUERIES = {"d17_title_pairs": title_pairs, "k12_content_pairs": content_pairs, "d16_banded_pairs": banded_pairs, "e13_losers": losers, "m01_pair_verdicts": pair_verdicts}

_TITLE = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^\\p{L}\\p{Nd}]+', ' ', 'g'), ' '), ' '), lambda w: w <> ''))"
_GRAMS = """(SELECT CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))) ELSE list_distinct(w) END
  FROM (SELECT list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', ' ', 'g'), ' '), ' '), lambda x: x <> '') AS w))"""
_AUTH = "SELECT d.*, coalesce(published_at, fetched_at) AS seen, authority_score FROM docs d JOIN src ON code = source_code"


def _all_pairs(sets: str, near: float) -> str:
    """All pairs of rows whose sets are alike: by the common tokens of every two rows."""
    return f"""also sets AS ({sets}), tok AS (SELECT id, len(s) AS n, unnest(s) AS t FROM sets),
      met AS (SELECT x.id AS a, y.id AS b, count(*) AS common, any_value(x.n) AS n, any_value(y.n) AS m FROM tok x JOIN tok y ON x.t = y.t AND x.id < y.id GROUP BY x.id, y.id)
      SELECT a, b, round(common / (n + m - common), 6) AS overlap FROM met WHERE common / (n + m - common) >= {near}"""


def _pairs(sets: str, near: float) -> str:
    return f"""also sets AS ({sets}), reps AS (SELECT list_sort(s) AS s, min(id) AS id FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)), tok AS (SELECT id, len(s) AS n, unnest(s) AS t FROM reps),
      met AS (SELECT x.id AS a, y.id AS b, count(*) AS common, any_value(x.n) AS n, any_value(y.n) AS m FROM tok x JOIN tok y ON x.t = y.t AND x.id < y.id GROUP BY x.id, y.id)
      SELECT a, b, round(common / (n + m - common), 6) AS overlap FROM met WHERE common / (n + m - common) >= {near}"""


def banded_sql(rows: str, band: int, exact: list[str], sets: dict[str, float]) -> str:
    """The links of banded_links over ``rows`` (id, seen, values, sorted lists of words), found among all pairs within the band."""
    earlier = "(y.seen < x.seen OR (y.seen = x.seen AND y.id < x.id))"
    both = "len(list_intersect(x.{0}, y.{0})) / len(list_distinct(list_concat(x.{0}, y.{0})))"
    parts = [f"SELECT id AS x, before AS y FROM (SELECT id, seen, lag(id) OVER w AS before, lag(seen) OVER w AS was FROM r WHERE {c} IS NOT NULL WINDOW w AS (PARTITION BY {c} ORDER BY seen, id)) WHERE epoch(seen) - epoch(was) <= {band}" for c in (*exact, *sets)]
    parts += [f"""SELECT x, y FROM (SELECT x.id AS x, y.id AS y, row_number() OVER (PARTITION BY x.id, y.{c}, {earlier} ORDER BY abs(epoch(x.seen) - epoch(y.seen)), CASE WHEN {earlier} THEN -y.id ELSE y.id END) AS rank
      FROM near JOIN r x ON x.id = near.x JOIN r y ON y.id = near.y WHERE {c}_o >= {near} AND x.{c} <> y.{c} AND (x.{c}_n < y.{c}_n OR (x.{c}_n = y.{c}_n AND x.{c}_first > y.{c}_first))) WHERE rank = 1""" for c, near in sets.items()]
    sized = ", ".join(f"count(*) OVER (PARTITION BY {c}) AS {c}_n, min(id) OVER (PARTITION BY {c}) AS {c}_first" for c in sets)
    overlap = lambda c, near: f"CASE WHEN len(x.{c}) > 0 AND len(y.{c}) > 0 AND least(len(x.{c}), len(y.{c})) >= {near} * greatest(len(x.{c}), len(y.{c})) THEN {both.format(c)} END AS {c}_o"
    return f"""r AS (SELECT *, {sized} FROM ({rows})), near AS MATERIALIZED (SELECT x.id AS x, y.id AS y, {', '.join(overlap(c, near) for c, near in sets.items())} FROM r x JOIN r y ON x.id <> y.id AND abs(epoch(x.seen) - epoch(y.seen)) <= {band}),
      links AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM ({' UNION ALL '.join(parts)}))"""


ORACLE_SQL = {
    "d17_title_pairs": with_tables("docs", _pairs(f"SELECT id, {_TITLE} AS s FROM docs", 0.8)),
    "k12_content_pairs": with_tables("docs", _all_pairs("""SELECT id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))) ELSE list_distinct(w) END AS s
      FROM (SELECT id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', ' ', 'g'), ' '), ' '), lambda w: w <> '') AS w FROM docs)""", 0.92)),
    "d16_banded_pairs": with_tables("docs src", f"""also a AS ({_AUTH}), p AS (SELECT id, seen, authority_score AS s, lag(id) OVER w AS id0, lag(seen) OVER w AS seen0, lag(authority_score) OVER w AS s0 FROM a WINDOW w AS (PARTITION BY content_hash ORDER BY seen, id))
      SELECT least(id, id0) AS a, greatest(id, id0) AS b, 'DUPLICATE_CONTENT' AS verdict, CASE WHEN s > s0 THEN id WHEN s < s0 THEN id0 WHEN seen > seen0 THEN id ELSE least(id, id0) END AS winner FROM p WHERE seen <= seen0 + INTERVAL 72 HOUR"""),
    "e13_losers": with_tables("docs src", f"SELECT id, winner AS duplicate_of FROM (SELECT id, first_value(id) OVER (PARTITION BY content_hash ORDER BY authority_score DESC, seen DESC, id) AS winner FROM ({_AUTH})) WHERE id <> winner"),
    "m01_pair_verdicts": with_tables("docs src", f"""also {banded_sql(f"SELECT id, coalesce(published_at, fetched_at) AS seen, published_at, url, content_hash, authority_score AS auth, nullif(list_sort({_TITLE}), []) AS t, nullif(list_sort({_GRAMS}), []) AS g FROM docs JOIN src ON code = source_code WHERE parse_status = 'OK'", 259_200, ['url', 'content_hash'], {'t': 0.5, 'g': 0.92})},
      j AS (SELECT a, b, CASE WHEN x.url = y.url THEN 'EXACT_URL' WHEN x.content_hash = y.content_hash THEN 'EXACT_HASH' WHEN g_o >= 0.92 THEN 'JACCARD_TITLE' ELSE 'LLM_PAIRWISE' END AS method, CASE WHEN x.auth > y.auth THEN a WHEN x.auth < y.auth THEN b WHEN x.published_at > y.published_at THEN a WHEN x.published_at < y.published_at THEN b END AS better,
        CASE WHEN t_o >= 0.5 THEN round(t_o, 6) END AS title_overlap, CASE WHEN g_o >= 0.92 THEN round(g_o, 6) END AS content_overlap FROM links JOIN near ON near.x = a AND near.y = b JOIN r x ON x.id = a JOIN r y ON y.id = b)
      SELECT a, b, method, CASE WHEN method <> 'LLM_PAIRWISE' AND better IS NOT NULL THEN 'DUPLICATE_CONTENT' ELSE 'NEEDS_REVIEW' END AS verdict, CASE WHEN method <> 'LLM_PAIRWISE' THEN better END AS winner, title_overlap, content_overlap FROM j"""),
}
