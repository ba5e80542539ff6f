"""Admission of documents and facts: cascades, funnels, windows and chunk plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import classifications, documents, facts, sources, table, with_tables
from ..domains import AS_OF, CHUNK_CHARS
from ..functions import rules, text
from ..operators.relational import exact_ranks, rank_limited

NOW, HORIZON = f"{AS_OF} 00:00:00", 30


def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", rules.input_policy(NOW, HORIZON).alias("decision"), "chars")


def funnel(spark: SparkSession, sf_dir: str, samples: int = 5) -> DataFrame:
    """Documents per decision with the first ids of each."""
    rated = policy(spark, sf_dir)
    counts = rated.groupBy("decision").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    heads = rank_limited(rated, ["decision"], [F.col("id")], samples).groupBy("decision").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("samples"))
    return counts.join(heads, "decision")


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    # of the text only whether it is blank goes through the shuffle
    blank = F.when(F.coalesce(F.trim("text"), F.lit("")) != "", "x").otherwise("")
    docs = documents(spark, sf_dir).select("id", "content_hash", "parse_status", blank.alias("text"), "full_text", "chars")
    firsts = docs.groupBy("content_hash").agg(F.min("id").alias("first_id"))
    status = classifications(spark, sf_dir).select(F.col("doc_id").alias("id"), "status")
    joined = docs.join(firsts, "content_hash").join(status, "id", "left")
    return joined.select("id", rules.readiness(F.col("id") != F.col("first_id"), F.col("status")).alias("state"))


def refetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = F.when(~F.col("full_text"), "UNVERIFIED").when(F.col("chars") < 600, "SHORT")
    return documents(spark, sf_dir).select("source_code", need.alias("need")).where("need is not null").groupBy("source_code", "need").agg(F.count("*").alias("n"))


def length_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median and ninth decile of text lengths per language, exactly, by counts per length."""
    docs = documents(spark, sf_dir).select("lang", "chars")
    plain = docs.groupBy("lang").agg(
        F.count("*").alias("n"), F.min("chars").alias("least"), F.max("chars").alias("most"), F.round(F.avg("chars"), 3).alias("mean"), F.count_if(F.col("chars") > CHUNK_CHARS).alias("long_texts"),
    )
    ranks = exact_ranks(docs, ["lang"], "chars", {"median": F.floor(F.col("n") / 2) + 1, "p90": F.ceil(F.col("n") * 9 / 10)})
    both = plain.alias("s").join(ranks.alias("r"), F.col("s.lang").eqNullSafe(F.col("r.lang")), "left")
    return both.select("s.lang", "n", "least", "median", "p90", "most", "mean", "long_texts")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks of every text; small windows, so that most texts have several."""
    plan = text.chunk_plan(F.col("chars"), 2_000, 100)
    return documents(spark, sf_dir).select("id", F.explode(plan).alias("c")).select("id", "c.number", "c.begin", "c.end")


def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = documents(spark, sf_dir).select("lang", F.size(text.chunk_plan(F.col("chars"))).alias("n"))
    return planned.groupBy("lang").agg(
        F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multi"), F.max("n").alias("most"), F.sum("n").alias("chunks"),
    )


def report_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of documents and sources that reports may use."""
    allowed = sources(spark, sf_dir).where("use_policy <> 'ARCHIVE_ONLY'").select(F.col("code").alias("source_code"), "authority", "use_policy")
    return facts(spark, sf_dir).where("not sample").join(allowed, "source_code").select("code", "doc_id", "fact_type", "authority", "use_policy", "full_text")


def future_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit(AS_OF).cast("date")
    open_end = (F.col("expiry").isNull() | (F.col("expiry") >= day)) & ~F.coalesce(F.col("expiry") < F.col("effective"), F.lit(False))
    return facts(spark, sf_dir).where(open_end).groupBy("fact_type").agg(F.count("*").alias("n"), F.count("expiry").alias("with_expiry"))


def analyst_eligible(spark: SparkSession, sf_dir: str, most_days: int = 90) -> DataFrame:
    """Why facts are left out of analysis, counted; the first reason counts."""
    shown = F.coalesce("occurred", "published")
    age = F.datediff(F.lit(AS_OF).cast("date"), shown)
    reason = F.when(F.col("sample"), "SAMPLE").when(shown.isNull(), "UNDATED").when(age > most_days, "TOO_OLD").when(age < -90, "FUTURE").when(~rules.attribution_safe(), "UNSAFE").otherwise("SELECTED")
    return facts(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def window_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("code", rules.window_class("2026-07-01", "2026-07-31", 90).alias("inclusion"))


def temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("code", rules.temporal_status(AS_OF).alias("status"), rules.temporal_role().alias("role"), rules.age_days(F.col("published"), AS_OF).alias("age"))


def cadences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts per report window of 7, 30 and 90 days that ends today; one pass over the facts."""
    day = F.coalesce("occurred", "published")
    windows = spark.createDataFrame([(7,), (30,), (90,)], "days int")
    dated = facts(spark, sf_dir).select("doc_id", day.alias("day")).where("day is not null")
    end = F.lit(AS_OF).cast("date")
    within = F.col("day").between(F.date_sub(end, F.col("days") - 1), end)
    return dated.join(F.broadcast(windows), within).groupBy("days").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    problem = F.coalesce(rules.https_problem(F.col("url")), F.lit("SAFE"))
    return table(spark, sf_dir, "pages").select("page_id", problem.alias("problem"), F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"))


def insert_if_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a second delivery adds: content not stored before, the first of each content."""
    docs = documents(spark, sf_dir).select("id", "content_hash")
    stored = docs.where("id % 3 <> 0").select("content_hash").distinct()
    return docs.where("id % 3 = 0").join(stored, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("id").alias("id"))


def ingest_cap(spark: SparkSession, sf_dir: str, most: int = 25) -> DataFrame:
    docs = documents(spark, sf_dir).select("id", "source_code", "url", "fetched_at")
    return rank_limited(docs, ["source_code"], [F.col("fetched_at"), F.col("id")], most).select("source_code", "id", "url")


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("id", "source_code", "chars", "intake")
    joined = docs.join(sources(spark, sf_dir), F.col("code") == F.col("source_code"))
    return joined.groupBy("authority", "use_policy").agg(
        F.count("*").alias("docs"), F.count_distinct("source_code").alias("sources"), F.sum("chars").alias("chars"), F.count_if(F.col("intake") == "CRAWLED").alias("crawled"),
    )


QUERIES = {
    "c09_input_policy": policy, "f07_rejection_funnel": funnel, "c11_extraction_readiness": readiness, "c23_refetch_need": refetch, "f06_length_statistics": length_statistics,
    "k17_chunk_plan": chunks, "f08_chunk_coverage": chunk_coverage, "c01_report_facts": report_facts, "c07_future_action": future_action, "c13_analyst_eligibility": analyst_eligible,
    "m04_window_classes": window_classes, "m05_temporal_status": temporal, "j03_cadence_windows": cadences, "c15_url_safety": url_safety, "b01_insert_if_new": insert_if_new,
    "g21_ingest_cap": ingest_cap, "d01_source_mix": source_mix,
}

_POLICY = """CASE WHEN sample THEN 'SAMPLE_DATA' WHEN coalesce(trim(text, ' '), '') = '' THEN 'EMPTY_CONTENT' WHEN NOT full_text THEN 'NEEDS_FULL_TEXT' WHEN chars < 600 THEN 'SHORT_CONTENT' WHEN published_at IS NULL THEN 'DATE_UNRESOLVED'
  WHEN published_at > TIMESTAMP '2026-08-08' THEN 'FUTURE_DATED' WHEN published_at < TIMESTAMP '2026-07-07' THEN 'OUTSIDE_ANALYSIS_HORIZON' WHEN strip_accents(lower(title)) SIMILAR TO '.*(holiday closure notice|office closure notice).*' THEN 'NON_INTELLIGENCE_CONTENT' ELSE 'ELIGIBLE' END"""
ORACLE_SQL = {
    "c09_input_policy": with_tables("docs", f"SELECT id, {_POLICY} AS decision, chars FROM docs"),
    "f07_rejection_funnel": with_tables("docs", f"""SELECT decision, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars, string_agg(CASE WHEN rn <= 5 THEN CAST(id AS VARCHAR) END, ',' ORDER BY id) AS samples
      FROM (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY id) AS rn FROM (SELECT id, chars, {_POLICY} AS decision FROM docs)) GROUP BY decision"""),
    "c11_extraction_readiness": with_tables("docs cls", """SELECT id, CASE WHEN id <> first_id THEN 'DUPLICATE' WHEN parse_status <> 'OK' THEN 'PARSE_FAILED' WHEN trim(text, ' ') = '' THEN 'EMPTY' WHEN NOT full_text THEN 'NEEDS_FULL_TEXT'
      WHEN chars < 600 THEN 'SHORT' WHEN status IS DISTINCT FROM 'CONFIRMED' THEN 'NOT_CONFIRMED' ELSE 'READY' END AS state FROM (SELECT *, min(id) OVER (PARTITION BY content_hash) AS first_id FROM docs) d LEFT JOIN cls ON doc_id = id"""),
    "c23_refetch_need": with_tables("docs", "SELECT source_code, CASE WHEN NOT full_text THEN 'UNVERIFIED' ELSE 'SHORT' END AS need, count(*) AS n FROM docs WHERE NOT full_text OR chars < 600 GROUP BY ALL"),
    "f06_length_statistics": with_tables("docs", """SELECT lang, count(*) AS n, min(chars) AS least, list(chars ORDER BY chars)[count(*) // 2 + 1] AS median, list(chars ORDER BY chars)[CAST(ceil(count(*) * 0.9) AS INT)] AS p90,
      max(chars) AS most, round(avg(chars), 3) AS mean, count(*) FILTER (chars > 24000) AS long_texts FROM docs GROUP BY lang"""),
    "k17_chunk_plan": with_tables("docs", """SELECT id, CAST(k AS INT) AS number, CAST(k * 1900 AS BIGINT) AS begin, least(k * 1900 + 2000, chars) AS end
      FROM (SELECT id, chars, unnest(range(0, greatest(1, CAST(ceil((chars - 100) / 1900) AS BIGINT)))) AS k FROM docs WHERE chars > 0)"""),
    "f08_chunk_coverage": with_tables("docs", """SELECT lang, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS multi, CAST(max(n) AS INT) AS most, CAST(sum(n) AS BIGINT) AS chunks
      FROM (SELECT lang, greatest(1, ceil((chars - 1200) / 22800)) AS n FROM docs WHERE chars > 0) GROUP BY lang"""),
    "c01_report_facts": with_tables("facts src", "SELECT f.code, doc_id, fact_type, authority, use_policy, full_text FROM facts f JOIN src s ON s.code = source_code WHERE NOT sample AND use_policy <> 'ARCHIVE_ONLY'"),
    "c07_future_action": with_tables("facts", "SELECT fact_type, count(*) AS n, count(expiry) AS with_expiry FROM facts WHERE expiry IS NULL OR (expiry >= DATE '2026-08-06' AND (effective IS NULL OR expiry >= effective)) GROUP BY fact_type"),
    "c13_analyst_eligibility": with_tables("facts", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN sample THEN 'SAMPLE' WHEN coalesce(occurred, published) IS NULL THEN 'UNDATED' WHEN DATE '2026-08-06' - coalesce(occurred, published) > 90 THEN 'TOO_OLD'
      WHEN DATE '2026-08-06' - coalesce(occurred, published) < -90 THEN 'FUTURE' WHEN NOT (entity_status = 'RESOLVED' OR company IS NULL) THEN 'UNSAFE' ELSE 'SELECTED' END AS reason FROM facts) GROUP BY reason"""),
    "m04_window_classes": with_tables("facts", """SELECT code, CASE WHEN occurred BETWEEN DATE '2026-07-01' AND DATE '2026-07-31' OR effective BETWEEN DATE '2026-07-01' AND DATE '2026-07-31' OR expiry BETWEEN DATE '2026-07-01' AND DATE '2026-07-31' THEN 'CURRENT_EVENT'
      WHEN published <= DATE '2026-07-31' AND (effective BETWEEN DATE '2026-08-01' AND DATE '2026-10-29' OR expiry BETWEEN DATE '2026-08-01' AND DATE '2026-10-29' OR forecast BETWEEN DATE '2026-08-01' AND DATE '2026-10-29') THEN 'UPCOMING_ANNOUNCED_EVENT'
      WHEN published BETWEEN DATE '2026-07-01' AND DATE '2026-07-31' THEN CASE WHEN occurred < DATE '2026-07-01' OR effective < DATE '2026-07-01' THEN 'NEW_DISCLOSURE_WITH_HISTORICAL_CONTEXT' ELSE 'CURRENT_EVENT' END ELSE 'EXCLUDE' END AS inclusion FROM facts"""),
    "m05_temporal_status": with_tables("facts", """SELECT code, CASE WHEN expiry < effective THEN 'INVALID_DATE_RANGE' WHEN expiry < DATE '2026-08-06' THEN 'EXPIRED' WHEN effective > DATE '2026-08-06' OR forecast > DATE '2026-08-06' THEN 'UPCOMING'
      WHEN effective IS NOT NULL OR occurred IS NOT NULL OR expiry IS NOT NULL THEN 'ACTIVE' ELSE 'UNDATED' END AS status, CASE WHEN forecast IS NOT NULL THEN 'FORECAST' WHEN expiry IS NOT NULL THEN 'EXPIRING' WHEN effective IS NOT NULL THEN 'EFFECTIVE'
      WHEN occurred IS NOT NULL THEN 'OCCURRED' WHEN published IS NOT NULL THEN 'PUBLICATION_ONLY' ELSE 'UNDATED' END AS role, CASE WHEN published IS NULL THEN 0 ELSE CAST(greatest(DATE '2026-08-06' - published, 0) AS INT) END AS age FROM facts"""),
    "j03_cadence_windows": with_tables("facts", """SELECT days, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (VALUES (7), (30), (90)) w(days) JOIN facts ON coalesce(occurred, published) BETWEEN DATE '2026-08-06' - (days - 1) AND DATE '2026-08-06' GROUP BY days"""),
    "c15_url_safety": """SELECT page_id, CASE WHEN coalesce(trim(url, ' '), '') = '' THEN 'EMPTY' WHEN length(url) > 1000 THEN 'TOO_LONG' WHEN NOT starts_with(url, 'https://') THEN 'NOT_HTTPS' WHEN regexp_extract(url, '^[a-z]+://([^/?#]*)@', 1) <> '' THEN 'USER_INFO'
      WHEN contains(url, '#') THEN 'FRAGMENT' WHEN regexp_extract(url, '^https://[^/?#]*:([0-9]+)', 1) NOT IN ('', '443') THEN 'PORT' WHEN regexp_matches(url, '^https://[0-9.]+([/:?#]|$)') THEN 'IP_LITERAL' ELSE 'SAFE' END AS problem,
      lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages""",
    "b01_insert_if_new": with_tables("docs", "SELECT content_hash, min(id) AS id FROM docs WHERE id % 3 = 0 AND content_hash NOT IN (SELECT content_hash FROM docs WHERE id % 3 <> 0) GROUP BY content_hash"),
    "g21_ingest_cap": with_tables("docs", "SELECT source_code, id, url FROM docs QUALIFY row_number() OVER (PARTITION BY source_code ORDER BY fetched_at, id) <= 25"),
    "d01_source_mix": with_tables("docs src", "SELECT authority, use_policy, count(*) AS docs, count(DISTINCT source_code) AS sources, CAST(sum(chars) AS BIGINT) AS chars, count(*) FILTER (intake = 'CRAWLED') AS crawled FROM docs JOIN src ON code = source_code GROUP BY ALL"),
}
