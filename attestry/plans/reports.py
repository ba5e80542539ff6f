"""Report rules: verdict aggregates, editions, placements, risk and small text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import classifications, claims, documents, facts, sources, table, verifications, with_tables
from ..domains import APPROVED
from ..functions import text
from ..operators.relational import latest, numbered, rank_limited

LATEST = ["created", "t1", "t2", "t3"]


def bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict from those of a claim's versions: the worst counts, and agreement is needed."""
    g = verifications(spark, sf_dir).groupBy("claim_id").agg(F.collect_set("verdict").alias("v"))
    has = lambda x: F.array_contains("v", x)
    verdict = F.when(has("CONTRADICTED"), "CONTRADICTED").when(has("VERIFIER_ERROR"), "VERIFIER_ERROR").when(has("NEUTRAL"), "NEUTRAL").otherwise("ENTAILED")
    return g.select("claim_id", verdict.alias("verdict"), (F.size("v") == 1).alias("agreed"))


def risk_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of regulators and statutory disclosures, and sample facts, carry the higher risk."""
    s = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "authority")
    tier = F.when(F.col("sample") | F.col("authority").isin("REGULATOR", "STATUTORY_DISCLOSURE"), "T3").otherwise("T1")
    return facts(spark, sf_dir).join(s, "source_code").groupBy(tier.alias("tier"), "fact_type").agg(F.count("*").alias("n"))


def magazine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions per month: ready with three decision-grade claims, a watch brief with one safe claim."""
    v = latest(verifications(spark, sf_dir), ["claim_id"], LATEST, ["verdict"])
    c = claims(spark, sf_dir).where("gate_status = 'PASS'").join(v, "claim_id")
    ok = F.col("review_status").isin(*APPROVED)
    g = c.groupBy(F.date_format("created", "yyyy-MM").alias("month")).agg(F.count_if(ok & (F.col("verdict") == "ENTAILED")).alias("ready"), F.count_if(ok & (F.col("verdict") == "NEUTRAL")).alias("watch"), F.count("*").alias("n"))
    return g.select("month", "ready", "watch", "n", F.when(F.col("ready") >= 3, "READY").when(F.col("ready") + F.col("watch") >= 1, "WATCH_BRIEF").otherwise("INSUFFICIENT").alias("status"))


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four executive and two watch places per tier, highlights first, newest first."""
    c = claims(spark, sf_dir).where(F.col("review_status").isin(*APPROVED))
    placed = c.select("tier", "claim_id", "created", F.when(F.col("claim_id") % 3 == 0, "EXECUTIVE").otherwise("WATCH").alias("place"), (F.col("claim_id") % 4 == 0).alias("highlight"))
    ranked = numbered(placed, ["tier", "place"], [F.desc("highlight"), F.desc("created"), F.col("claim_id")])
    return ranked.where(((F.col("place") == "EXECUTIVE") & (F.col("rank") <= 4)) | (F.col("rank") <= 2)).select("tier", "place", "rank", "claim_id")


def current_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest edition of each window length is current; every claim stands for an edition."""
    e = claims(spark, sf_dir).select(F.col("claim_id").alias("edition"), F.element_at(F.array(F.lit(7), F.lit(30), F.lit(90)), (F.col("claim_id") % 3 + 1).cast("int")).alias("days"), "created")
    newest = e.groupBy("days").agg(F.max(F.struct("created", "edition"))["edition"].alias("newest"))
    return e.join(newest, "days").select("edition", "days", (F.col("edition") == F.col("newest")).alias("current"))


def share_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's only percentage, kept where all its lines that have one agree."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\d+(?:[.,]\d+)?)%"), 1))
    return documents(spark, sf_dir).select("id", found.alias("p")).where("size(p) > 0").select("id", F.when(F.size("p") == 1, F.element_at("p", 1)).alias("share"), F.size("p").alias("n"))


def synthesis_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of eligible documents with facts, per language, against the threshold."""
    have = facts(spark, sf_dir).select(F.col("doc_id").alias("id")).distinct().withColumn("f", F.lit(True))
    ok = classifications(spark, sf_dir).where("status = 'CONFIRMED'").select(F.col("doc_id").alias("id"))
    g = documents(spark, sf_dir).select("id", "lang").join(ok, "id").join(have, "id", "left").groupBy("lang").agg(F.count("*").alias("eligible"), F.count("f").alias("represented"))
    share = F.col("represented") / F.col("eligible")
    return g.select("lang", "eligible", "represented", F.round(100 * share, 1).alias("percent"), (share >= 0.9).alias("ready"))


def alert_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert lines of approved claims; a line without a value is left out."""
    c = claims(spark, sf_dir).where(F.col("review_status").isin(*APPROVED))
    line = F.concat_ws("\n", F.concat(F.lit("Claim "), F.col("claim_id").cast("string")), F.when(F.col("tier") >= "T3", F.concat(F.lit("Tier "), "tier")), F.concat(F.lit("Status "), "review_status"))
    return c.select("claim_id", line.alias("message"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by declared code, else by letters that only some languages have."""
    t = F.lower("text")
    guess = F.when(t.rlike("[äöüß]"), "de").when(t.rlike("[ñ¿¡]"), "es").when(t.rlike("[çêèœ]"), "fr").otherwise("en")
    return documents(spark, sf_dir).groupBy("lang", guess.alias("guessed")).agg(F.count("*").alias("n"))


SHINGLE_CHARS, MOST_SHINGLES = 8000, 700  # fixed values of the story comparison


def shingle_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shingles that stories are compared by: distinct runs of five words, 700 at most, of a text's first 8,000 characters."""
    words = F.filter(F.split(text.normal_title(F.substring("text", 1, SHINGLE_CHARS), "N"), " "), lambda w: w != "")
    many = F.greatest(F.size("w") - 4, F.lit(0))
    runs = F.slice("w", F.lit(1), many)
    for k in range(2, 6):
        runs = F.zip_with(runs, F.slice("w", F.lit(k), many), lambda a, b: F.concat_ws(" ", a, b))
    found = documents(spark, sf_dir).select("id", words.alias("w")).select("id", F.slice(F.array_distinct(runs), 1, MOST_SHINGLES).alias("s"))
    return found.select("id", F.size("s").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("shingles_sha"))


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per cluster key after a second run: keys of the new run replace the old rows."""
    old = facts(spark, sf_dir).where("pos < 6").groupBy("fact_type", "source_code").agg(F.count("*").alias("n"))
    new = facts(spark, sf_dir).where("pos % 2 = 0 and source_code < 'src2'").groupBy("fact_type", "source_code").agg(F.count("*").alias("n"))
    kept = old.join(new.select("fact_type", "source_code"), ["fact_type", "source_code"], "left_anti")
    return kept.unionByName(new).groupBy("fact_type").agg(F.count("*").alias("keys"), F.sum("n").alias("n"))


def without_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and classifications that stay when sample documents are deleted, in key order."""
    gone = documents(spark, sf_dir).where("sample").select(F.col("id").alias("doc_id"))
    f = facts(spark, sf_dir).join(gone, "doc_id", "left_anti").agg(F.count("*").alias("n")).withColumn("table", F.lit("facts"))
    c = classifications(spark, sf_dir).join(gone, "doc_id", "left_anti").agg(F.count("*").alias("n")).withColumn("table", F.lit("classifications"))
    return f.unionByName(c).select("table", "n")


def activity_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last day of each company's activity inside the window."""
    first_day, last_day = F.lit("2026-06-15").cast("date"), F.lit("2026-07-31").cast("date")
    day = F.coalesce(*(F.when(F.col(c).between(first_day, last_day), F.col(c)) for c in ("occurred", "effective", "published")))
    return facts(spark, sf_dir).where("company is not null").groupBy("company").agg(F.min(day).alias("from_day"), F.max(day).alias("to_day"), F.count(day).alias("n"))


def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the planner's order: primary sources, home market, newest, then source and id."""
    s = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "primary_source", "authority_score", (F.coalesce("market", F.lit("")) == "VN").alias("home"))
    d = documents(spark, sf_dir).select("id", "source_code", "published_at", "lang").join(s, "source_code")
    order = [F.desc("authority_score"), F.desc("primary_source"), F.desc("home"), F.desc_nulls_last("published_at"), F.col("source_code"), F.col("id")]
    return rank_limited(d, ["lang"], order, 10).select("lang", "id")


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each role and what they make of a conversation's characters, in per cent."""
    t = table(spark, sf_dir, "conversations").select("role", F.length("text").alias("c"))
    g = t.groupBy("role").agg(F.count("*").alias("turns"), F.sum("c").alias("chars"))
    return g.join(g.agg(F.sum("chars").alias("total"))).select("role", "turns", "chars", F.round(100 * F.col("chars") / F.col("total"), 1).alias("percent"))


QUERIES = {
    "k27_bilingual_verdict": bilingual, "m13_risk_tiers": risk_tiers, "f28_magazine_status": magazine, "g19_placements": placements, "g17_current_flags": current_flags, "f32_share_agreement": share_agreement,
    "f31_synthesis_readiness": synthesis_readiness, "k29_alert_texts": alert_texts, "k30_language_guess": languages, "k13_story_shingles": shingle_sets, "e10_cluster_upsert": upserted,
    "l03_sample_cascade": without_samples, "m33_activity_dates": activity_dates, "h02_candidate_order": candidate_order, "k43_percent_of_chars": roles,
}

_OK = "('AUTO_APPROVED', 'APPROVED', 'EDITED_APPROVED', 'FORCE_APPROVED')"
ORACLE_SQL = {
    "k27_bilingual_verdict": with_tables("checks", "SELECT claim_id, CASE WHEN bool_or(verdict = 'CONTRADICTED') THEN 'CONTRADICTED' WHEN bool_or(verdict = 'VERIFIER_ERROR') THEN 'VERIFIER_ERROR' WHEN bool_or(verdict = 'NEUTRAL') THEN 'NEUTRAL' ELSE 'ENTAILED' END AS verdict, count(DISTINCT verdict) = 1 AS agreed FROM checks GROUP BY claim_id"),
    "m13_risk_tiers": with_tables("facts src", "SELECT CASE WHEN sample OR authority IN ('REGULATOR', 'STATUTORY_DISCLOSURE') THEN 'T3' ELSE 'T1' END AS tier, fact_type, count(*) AS n FROM facts JOIN src s ON s.code = source_code GROUP BY ALL"),
    "f28_magazine_status": with_tables("claims latest", f"""SELECT month, ready, watch, n, CASE WHEN ready >= 3 THEN 'READY' WHEN ready + watch >= 1 THEN 'WATCH_BRIEF' ELSE 'INSUFFICIENT' END AS status FROM (SELECT strftime(created, '%Y-%m') AS month, count(*) FILTER (review_status IN {_OK} AND verdict = 'ENTAILED') AS ready,
      count(*) FILTER (review_status IN {_OK} AND verdict = 'NEUTRAL') AS watch, count(*) AS n FROM claims JOIN latest USING (claim_id) WHERE gate_status = 'PASS' GROUP BY ALL)"""),
    "g19_placements": with_tables("claims", f"""SELECT tier, place, CAST(rn AS INT) AS rank, claim_id FROM (SELECT *, row_number() OVER (PARTITION BY tier, place ORDER BY claim_id % 4 = 0 DESC, created DESC, claim_id) AS rn FROM (SELECT *, CASE WHEN claim_id % 3 = 0 THEN 'EXECUTIVE' ELSE 'WATCH' END AS place FROM claims WHERE review_status IN {_OK}))
      WHERE rn <= CASE place WHEN 'EXECUTIVE' THEN 4 ELSE 2 END"""),
    "g17_current_flags": with_tables("claims", "SELECT edition, days, row_number() OVER (PARTITION BY days ORDER BY created DESC, edition DESC) = 1 AS current FROM (SELECT claim_id AS edition, CASE claim_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 30 ELSE 90 END AS days, created FROM claims)"),
    "f32_share_agreement": with_tables("docs", "SELECT id, CASE WHEN len(p) = 1 THEN p[1] END AS share, CAST(len(p) AS INT) AS n FROM (SELECT id, list_distinct(regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)?)%', 1)) AS p FROM docs) WHERE len(p) > 0"),
    "f31_synthesis_readiness": with_tables("facts", """SELECT lang, count(*) AS eligible, count(f.doc_id) AS represented, round(100 * count(f.doc_id) / count(*), 1) AS percent, count(f.doc_id) / count(*) >= 0.9 AS ready FROM docs JOIN cls ON cls.doc_id = id AND status = 'CONFIRMED' LEFT JOIN (SELECT DISTINCT doc_id FROM facts) f ON f.doc_id = id GROUP BY lang"""),
    "k29_alert_texts": with_tables("claims", f"SELECT claim_id, concat_ws(chr(10), 'Claim ' || claim_id, CASE WHEN tier >= 'T3' THEN 'Tier ' || tier END, 'Status ' || review_status) AS message FROM claims WHERE review_status IN {_OK}"),
    "k30_language_guess": with_tables("docs", "SELECT lang, CASE WHEN regexp_matches(lower(text), '[äöüß]') THEN 'de' WHEN regexp_matches(lower(text), '[ñ¿¡]') THEN 'es' WHEN regexp_matches(lower(text), '[çêèœ]') THEN 'fr' ELSE 'en' END AS guessed, count(*) AS n FROM docs GROUP BY ALL"),
    "k13_story_shingles": with_tables("docs", """SELECT id, CAST(len(s) AS INT) AS n, sha256(array_to_string(s, '|')) AS shingles_sha FROM (SELECT id, list_transform(list_slice(list_sort(list_transform(list_distinct(r), lambda x: {'at': list_position(r, x), 'x': x})), 1, 700), lambda y: y.x) AS s
      FROM (SELECT id, list_transform(range(1, greatest(len(w) - 3, 1)), lambda k: array_to_string(w[k:k + 4], ' ')) AS r FROM (SELECT id, list_filter(string_split(trim(regexp_replace(lower(substr(text, 1, 8000)), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), ' '), lambda w: w <> '') AS w FROM docs)))"""),
    "e10_cluster_upsert": with_tables("facts", """also o AS (SELECT fact_type, source_code, count(*) AS n FROM facts WHERE pos < 6 GROUP BY ALL), w AS (SELECT fact_type, source_code, count(*) AS n FROM facts WHERE pos % 2 = 0 AND source_code < 'src2' GROUP BY ALL)
      SELECT fact_type, count(*) AS keys, CAST(sum(n) AS BIGINT) AS n FROM (SELECT coalesce(w.fact_type, o.fact_type) AS fact_type, coalesce(w.n, o.n) AS n FROM o FULL JOIN w ON o.fact_type = w.fact_type AND o.source_code = w.source_code) GROUP BY fact_type"""),
    "l03_sample_cascade": with_tables("facts", "SELECT 'facts' AS \"table\", count(*) AS n FROM facts WHERE NOT sample UNION ALL SELECT 'classifications', count(*) FROM cls WHERE doc_id NOT IN (SELECT id FROM docs WHERE sample)"),
    "m33_activity_dates": with_tables("facts", """SELECT company, min(d) AS from_day, max(d) AS to_day, count(d) AS n FROM (SELECT company, CASE WHEN occurred BETWEEN DATE '2026-06-15' AND DATE '2026-07-31' THEN occurred WHEN effective BETWEEN DATE '2026-06-15' AND DATE '2026-07-31' THEN effective
      WHEN published BETWEEN DATE '2026-06-15' AND DATE '2026-07-31' THEN published END AS d FROM facts WHERE company IS NOT NULL) GROUP BY company"""),
    "h02_candidate_order": with_tables("docs src", "SELECT lang, id FROM docs JOIN src ON code = source_code QUALIFY row_number() OVER (PARTITION BY lang ORDER BY authority_score DESC, primary_source DESC, market IS NOT DISTINCT FROM 'VN' DESC, published_at DESC NULLS LAST, source_code, id) <= 10"),
    "k43_percent_of_chars": "SELECT role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, round(100 * sum(length(text)) / sum(sum(length(text))) OVER (), 1) AS percent FROM conversations GROUP BY role",
}
