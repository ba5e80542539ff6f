"""Market events: normalising, clustering, scoring, selection and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import documents, facts, sources, with_tables
from ..domains import AS_OF
from ..functions import rules
from ..operators.relational import first, numbered, numbered_by_range, rank_limited

VERSION = "v2"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market event per fact, with its anchor date, month, scope and cluster key."""
    src = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "authority", "authority_score", "primary_source", "market", "use_policy")
    joined = facts(spark, sf_dir).join(src, "source_code")
    anchor = F.coalesce("occurred", "effective", "published")
    month = F.coalesce(F.date_format(anchor, "yyyy-MM"), F.lit("UNDATED"))
    market = F.coalesce("market", F.lit("UNKNOWN"))
    lane = F.when(F.col("company").isNotNull(), F.concat_ws("|", F.lit("E"), "company", "fact_type", month)).when(
        F.col("kpi_label").isNotNull(), F.concat_ws("|", F.lit("K"), "kpi_label", market, month)
    ).otherwise(F.concat_ws("|", F.lit("F"), "code"))
    return joined.select(
        "code", "doc_id", "source_code", "fact_type", "company", "kpi_label", "occurred", "effective", "expiry", "published", "highlight", "authority", "authority_score", "primary_source", "use_policy",
        market.alias("market"), anchor.alias("anchor"), month.alias("month"), F.concat(F.lit("ME:"), "code", F.lit(":"), F.substring(F.sha2(F.concat_ws("|", "code", F.lit(VERSION)), 256), 1, 16)).alias("event_key"),
        F.sha2(lane, 256).alias("cluster_key"), rules.attribution_safe().alias("safe"),
    )


def joined_set(column: str) -> Column:
    return F.coalesce(F.array_join(F.array_sort(F.collect_set(column)), ","), F.lit(""))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of events on one story: counts, members, provenance, conflicting dates."""
    several = lambda c: F.count_distinct(c) > 1
    n_sources = F.count_distinct("source_code")
    return events(spark, sf_dir).groupBy("cluster_key").agg(
        F.count("*").alias("n_events"), F.count_distinct("doc_id").alias("n_docs"), n_sources.alias("n_sources"), joined_set("source_code").alias("sources"),
        F.min("anchor").alias("anchor"), F.min("event_key").alias("first_event"),
        F.when(n_sources > 1, "INDEPENDENT_SOURCES").when(F.count("*") > 1, "SAME_SOURCE").otherwise("SINGLE").alias("provenance"),
        F.when(several("occurred") | several("effective") | several("expiry"), "DATE_CONFLICT").otherwise("NONE").alias("conflict"),
    )


def missing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts for which this version has no event yet."""
    have = events(spark, sf_dir).where("primary_source").select("code")
    return facts(spark, sf_dir).join(have, "code", "left_anti").select("code", "doc_id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curation score of every event for the product department, and its band."""
    per_cluster = clusters(spark, sf_dir).select("cluster_key", "n_sources")
    e = events(spark, sf_dir).join(per_cluster, "cluster_key")
    relevance = F.when(F.col("fact_type").isin("PRODUCT_LAUNCH", "REGULATION"), 35).when(F.col("fact_type").isin("METRIC", "CORPORATE_ACTION"), 18).otherwise(6)
    total = (
        relevance + F.round(F.col("authority_score") * 0.2).cast("int") + rules.market_fit(F.when(F.col("market") != "UNKNOWN", F.col("market")), "VN")
        + rules.freshness(rules.age_days(F.col("published"), AS_OF)) + rules.corroboration(F.col("n_sources")) + F.when(F.col("highlight"), 5).otherwise(0)
    )
    score = F.when(F.col("safe"), F.greatest(F.lit(0), F.least(F.lit(100), total))).otherwise(0)
    return e.select("code", score.alias("score"), F.when(F.col("safe"), rules.band(score)).otherwise("HOLD_ENTITY_REVIEW").alias("band"))


def top_facts(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    e = scored(spark, sf_dir).join(facts(spark, sf_dir).select("code", "doc_id"), "code")
    best = rank_limited(e, ["doc_id"], [F.desc("score"), F.col("code")], most)
    return best.groupBy("doc_id").agg(F.max("score").alias("doc_score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "code"))), lambda x: x["code"]), ",").alias("codes"))


def one_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("doc_id", "code", (-F.datediff("anchor", F.lit("1970-01-01").cast("date"))).alias("d"), (-F.col("authority_score")).alias("a"))
    e = e.withColumn("undated", F.col("d").isNull())
    return first(e, ["doc_id"], ["undated", "d", "a", "code"], ["code"])


def balanced(spark: SparkSession, sf_dir: str, most: int = 12) -> DataFrame:
    """Coverage in turns: the best of every (market, type) cell, then the second best, up to a limit."""
    order = [F.desc_nulls_last("anchor"), F.desc("authority_score"), F.col("code")]
    ranked = numbered(events(spark, sf_dir).where("safe"), ["market", "fact_type"], order)
    return ranked.orderBy("rank", "market", "fact_type").limit(most).select("market", "fact_type", "rank", "code")


def last_months(as_of: str, count: int = 6) -> list[str]:
    year, month = int(as_of[:4]), int(as_of[5:7])
    return [f"{(year * 12 + month - 1 - k) // 12}-{(year * 12 + month - 1 - k) % 12 + 1:02d}" for k in range(count - 1, -1, -1)]


def pivot_months(spark: SparkSession, sf_dir: str, most: int = 10) -> DataFrame:
    """Events of each company in each of the last six months, the companies with the most first."""
    months = last_months(AS_OF)
    shown = events(spark, sf_dir).where(F.col("company").isNotNull() & F.col("month").isin(*months))
    counts = shown.groupBy("company").agg(F.count("*").alias("total"), *(F.count_if(F.col("month") == m).alias("m" + m.replace("-", "")) for m in months))
    return counts.orderBy(F.desc("total"), "company").limit(most)


def count_bars(spark: SparkSession, sf_dir: str, most: int = 6) -> DataFrame:
    """The most frequent companies with their share of the shown rows, two per cent at least."""
    from pyspark.sql import Window

    top = events(spark, sf_dir).where("company is not null").groupBy("company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").limit(most)
    share = F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()))
    return top.select("company", "n", F.greatest(F.lit(2), share.cast("int")).alias("percent"))


def priority_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("fact_type").agg(
        F.count("*").alias("n"), F.count_distinct("source_code").alias("n_sources"), F.count_distinct(F.when(F.col("primary_source"), F.col("source_code"))).alias("n_primary"),
        F.bool_or("primary_source").alias("any_primary"), F.bool_and("safe").alias("all_safe"), F.round(F.avg("authority_score"), 4).alias("mean_authority"),
    )


def deep_dives(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir).where("company is not null").groupBy("company").agg(F.count("*").alias("n"), F.count_distinct("fact_type").alias("types"))
    return g.where("n >= 3 or types >= 2")


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir).where("company is not null").groupBy("company").agg(F.count_distinct("source_code").alias("s"), F.count_distinct("cluster_key").alias("c"), F.bool_or("primary_source").alias("p"))
    level = F.when((F.col("s") >= 3) & (F.col("c") >= 2), "HIGH").when((F.col("s") >= 2) | F.col("p"), "MEDIUM").otherwise("LOW")
    return g.select("company", F.col("s").alias("n_sources"), F.col("c").alias("n_clusters"), level.alias("confidence"))


def market_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir).where("company is not null").groupBy("company").agg(F.array_sort(F.collect_set(F.when(F.col("market") != "UNKNOWN", F.col("market")))).alias("m"))
    return g.select("company", F.when(F.size("m") > 1, "Multi-market").when(F.size("m") == 1, F.element_at("m", 1)).otherwise("Unknown").alias("position"))


def audit_sample(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """The same few documents per stratum every time: the first by a hash with the snapshot's name."""
    docs = documents(spark, sf_dir).select("id", "lang", "source_code", F.sha2(F.concat(F.lit("snapshot-1|"), F.col("id").cast("string")), 256).alias("h"))
    return rank_limited(docs, ["lang"], [F.col("h")], most).select("lang", "id")


def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two facts a document in a type, six a type."""
    e = events(spark, sf_dir).select("fact_type", "doc_id", "code", "authority_score")
    order = [F.desc("authority_score"), F.col("code")]
    return rank_limited(rank_limited(e, ["fact_type", "doc_id"], order, 2), ["fact_type"], order, 6).select("fact_type", "doc_id", "code")


def slides(spark: SparkSession, sf_dir: str, rows: int = 7) -> DataFrame:
    ranked = numbered_by_range(events(spark, sf_dir).select("fact_type", "code"), ["fact_type"], ["code"])
    return ranked.groupBy("fact_type", F.floor((F.col("rank") - 1) / rows).alias("slide")).agg(F.count("*").alias("n"), F.min("code").alias("first_code"))


def edition_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint per type over its events, whatever their order: sums of two pieces of each row's hash."""
    row = F.sha2(F.concat_ws("|", "code", "cluster_key"), 256)
    piece = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    g = events(spark, sf_dir).select("fact_type", row.alias("h")).groupBy("fact_type").agg(F.count("*").alias("n"), piece(1).alias("a"), piece(16).alias("b"))
    return g.select("fact_type", F.sha2(F.concat_ws("|", "n", "a", "b"), 256).alias("fingerprint"))


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that occur in a market but not among what primary sources say there."""
    g = events(spark, sf_dir).groupBy("market").agg(F.collect_set("fact_type").alias("have"), F.collect_set(F.when(F.col("primary_source"), F.col("fact_type"))).alias("shown"))
    return g.select("market", F.array_join(F.array_sort(F.array_except("have", "shown")), ",").alias("missing"), F.size("have").alias("n_types"), F.size(F.array_intersect("have", "shown")).alias("n_shown"))


QUERIES = {
    "m27_market_events": lambda s, d: events(s, d).select("code", "event_key", "cluster_key", "market", "month", "anchor", "safe"), "f05_event_clusters": clusters, "d14_missing_events": missing_events,
    "m03_curation_score": scored, "g04_top_facts": top_facts, "g05_one_per_document": one_per_document, "g06_balanced_coverage": balanced, "f17_month_pivot": pivot_months, "f16_count_bars": count_bars,
    "f19_priority_areas": priority_areas, "f15_deep_dives": deep_dives, "f21_confidence": confidence, "f33_market_position": market_position, "g11_audit_sample": audit_sample, "g12_capped_per_key": capped,
    "g14_fixed_chunks": slides, "k46_fingerprint": edition_fingerprint, "f30_coverage_gaps": coverage_gaps,
}

_EV = """also ev AS (SELECT f.*, authority, authority_score, primary_source, use_policy, mk AS market, anchor, month, 'ME:' || code || ':' || substr(sha256(code || '|v2'), 1, 16) AS event_key,
    sha256(CASE WHEN company IS NOT NULL THEN concat_ws('|', 'E', company, fact_type, month) WHEN kpi_label IS NOT NULL THEN concat_ws('|', 'K', kpi_label, mk, month) ELSE 'F|' || code END) AS cluster_key, entity_status = 'RESOLVED' OR company IS NULL AS safe
  FROM (SELECT f.*, authority, authority_score, primary_source, use_policy, coalesce(market, 'UNKNOWN') AS mk, coalesce(occurred, effective, published) AS anchor,
    coalesce(strftime(coalesce(occurred, effective, published), '%Y-%m'), 'UNDATED') AS month FROM facts f JOIN src s ON s.code = f.source_code) f),
  cl AS (SELECT cluster_key, count(*) AS n_events, count(DISTINCT doc_id) AS n_docs, count(DISTINCT source_code) AS n_sources, string_agg(DISTINCT source_code, ',' ORDER BY source_code) AS sources, min(anchor) AS anchor, min(event_key) AS first_event,
    CASE WHEN count(DISTINCT source_code) > 1 THEN 'INDEPENDENT_SOURCES' WHEN count(*) > 1 THEN 'SAME_SOURCE' ELSE 'SINGLE' END AS provenance,
    CASE WHEN count(DISTINCT occurred) > 1 OR count(DISTINCT effective) > 1 OR count(DISTINCT expiry) > 1 THEN 'DATE_CONFLICT' ELSE 'NONE' END AS conflict FROM ev GROUP BY cluster_key),
  sc AS (SELECT code, doc_id, CASE WHEN safe THEN least(100, greatest(0, total)) ELSE 0 END AS score, safe FROM (SELECT code, doc_id, safe, CASE WHEN fact_type IN ('PRODUCT_LAUNCH', 'REGULATION') THEN 35 WHEN fact_type IN ('METRIC', 'CORPORATE_ACTION') THEN 18 ELSE 6 END
    + CAST(round(authority_score * 0.2) AS INT) + CASE market WHEN 'UNKNOWN' THEN 5 WHEN 'VN' THEN 15 WHEN 'GLOBAL' THEN 10 ELSE 6 END
    + CASE WHEN age <= 7 THEN 15 WHEN age <= 30 THEN 12 WHEN age <= 90 THEN 8 WHEN age <= 180 THEN 4 ELSE 1 END + CASE WHEN n_sources >= 3 THEN 15 WHEN n_sources = 2 THEN 11 WHEN n_sources = 1 THEN 5 ELSE 0 END + CASE WHEN highlight THEN 5 ELSE 0 END AS total
    FROM (SELECT ev.*, n_sources, coalesce(greatest(DATE '2026-08-06' - published, 0), 0) AS age FROM ev JOIN cl USING (cluster_key))))
"""
_T = "facts src"
ORACLE_SQL = {
    "m27_market_events": with_tables(_T, _EV + "SELECT code, event_key, cluster_key, market, month, anchor, safe FROM ev"),
    "f05_event_clusters": with_tables(_T, _EV + "SELECT * FROM cl"),
    "d14_missing_events": with_tables(_T, _EV + "SELECT code, doc_id FROM facts WHERE code NOT IN (SELECT code FROM ev WHERE primary_source)"),
    "m03_curation_score": with_tables(_T, _EV + "SELECT code, score, CASE WHEN NOT safe THEN 'HOLD_ENTITY_REVIEW' WHEN score >= 80 THEN 'SURFACE_NOW' WHEN score >= 60 THEN 'PRIORITY' WHEN score >= 40 THEN 'WATCH' ELSE 'BACKGROUND' END AS band FROM sc"),
    "g04_top_facts": with_tables(_T, _EV + "SELECT doc_id, max(score) AS doc_score, string_agg(code, ',' ORDER BY score DESC, code) AS codes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) AS rn FROM sc) WHERE rn <= 3 GROUP BY doc_id"),
    "g05_one_per_document": with_tables(_T, _EV + "SELECT doc_id, code FROM ev QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY anchor DESC NULLS LAST, authority_score DESC, code) = 1"),
    "g06_balanced_coverage": with_tables(_T, _EV + "SELECT market, fact_type, CAST(rn AS INT) AS rank, code FROM (SELECT *, row_number() OVER (PARTITION BY market, fact_type ORDER BY anchor DESC NULLS LAST, authority_score DESC, code) AS rn FROM ev WHERE safe) ORDER BY rn, market, fact_type LIMIT 12"),
    "f17_month_pivot": with_tables(_T, _EV + "SELECT company, count(*) AS total, " + ", ".join(f"count(*) FILTER (month = '{m[:4]}-{m[4:]}') AS m{m}" for m in ("202603", "202604", "202605", "202606", "202607", "202608")) + " FROM ev WHERE company IS NOT NULL AND month BETWEEN '2026-03' AND '2026-08' GROUP BY company ORDER BY total DESC, company LIMIT 10"),
    "f16_count_bars": with_tables(_T, _EV + "SELECT company, n, CAST(greatest(2, round(100 * n / sum(n) OVER ())) AS INT) AS percent FROM (SELECT company, count(*) AS n FROM ev WHERE company IS NOT NULL GROUP BY company ORDER BY n DESC, company LIMIT 6)"),
    "f19_priority_areas": with_tables(_T, _EV + "SELECT fact_type, count(*) AS n, count(DISTINCT source_code) AS n_sources, count(DISTINCT source_code) FILTER (primary_source) AS n_primary, bool_or(primary_source) AS any_primary, bool_and(safe) AS all_safe, round(avg(authority_score), 4) AS mean_authority FROM ev GROUP BY fact_type"),
    "f15_deep_dives": with_tables(_T, _EV + "SELECT company, count(*) AS n, count(DISTINCT fact_type) AS types FROM ev WHERE company IS NOT NULL GROUP BY company HAVING n >= 3 OR types >= 2"),
    "f21_confidence": with_tables(_T, _EV + "SELECT company, s AS n_sources, c AS n_clusters, CASE WHEN s >= 3 AND c >= 2 THEN 'HIGH' WHEN s >= 2 OR p THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (SELECT company, count(DISTINCT source_code) AS s, count(DISTINCT cluster_key) AS c, bool_or(primary_source) AS p FROM ev WHERE company IS NOT NULL GROUP BY company)"),
    "f33_market_position": with_tables(_T, _EV + "SELECT company, CASE WHEN count(DISTINCT nullif(market, 'UNKNOWN')) > 1 THEN 'Multi-market' ELSE coalesce(min(nullif(market, 'UNKNOWN')), 'Unknown') END AS position FROM ev WHERE company IS NOT NULL GROUP BY company"),
    "g11_audit_sample": with_tables("docs", "SELECT lang, id FROM docs QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('snapshot-1|' || id)) <= 3"),
    "g12_capped_per_key": with_tables(_T, _EV + "SELECT fact_type, doc_id, code FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY fact_type, doc_id ORDER BY authority_score DESC, code) <= 2) QUALIFY row_number() OVER (PARTITION BY fact_type ORDER BY authority_score DESC, code) <= 6"),
    "g14_fixed_chunks": with_tables(_T, _EV + "SELECT fact_type, (rn - 1) // 7 AS slide, count(*) AS n, min(code) AS first_code FROM (SELECT fact_type, code, row_number() OVER (PARTITION BY fact_type ORDER BY code) AS rn FROM ev) GROUP BY ALL"),
    "k46_fingerprint": with_tables(_T, _EV + "SELECT fact_type, sha256(count(*) || '|' || sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) || '|' || sum(CAST('0x' || substr(h, 16, 15) AS BIGINT))) AS fingerprint FROM (SELECT fact_type, sha256(code || '|' || cluster_key) AS h FROM ev) GROUP BY fact_type"),
    "f30_coverage_gaps": with_tables(_T, _EV + """SELECT market, coalesce(string_agg(CASE WHEN NOT p THEN fact_type END, ',' ORDER BY fact_type), '') AS missing, CAST(count(*) AS INT) AS n_types, CAST(count(*) FILTER (p) AS INT) AS n_shown
      FROM (SELECT market, fact_type, bool_or(primary_source) AS p FROM ev GROUP BY ALL) GROUP BY market"""),
}
