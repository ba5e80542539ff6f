"""Claims and their verdicts: latest rows, publication, review and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import claims, verifications, with_tables
from ..domains import APPROVED
from ..functions import rules
from ..operators.relational import latest, numbered, numbered_by_range, union_by_precedence

ORDER = ["created", "t1", "t2", "t3"]


def latest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(verifications(spark, sf_dir), ["claim_id"], ORDER, ["verdict"])


def with_verdict(spark: SparkSession, sf_dir: str, how: str = "left") -> DataFrame:
    return claims(spark, sf_dir).join(latest_verdicts(spark, sf_dir), "claim_id", how)


def publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved claims that passed the gate and whose latest verdict is ENTAILED."""
    kept = claims(spark, sf_dir).where(F.col("review_status").isin(*APPROVED) & (F.col("gate_status") == "PASS") & ~F.col("superseded"))
    entailed = latest_verdicts(spark, sf_dir).where("verdict = 'ENTAILED'")
    return kept.join(entailed, "claim_id").select("claim_id", "doc_id", "review_status", "verdict")


def not_contradicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = with_verdict(spark, sf_dir).where(F.col("review_status").isin(*APPROVED) & (F.coalesce("verdict", F.lit("")) != "CONTRADICTED"))
    return kept.select("claim_id", "review_status", F.coalesce("verdict", F.lit("NONE")).alias("verdict"))


def retryable(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = with_verdict(spark, sf_dir, "inner")
    return joined.where("verdict = 'VERIFIER_ERROR' and gate_status = 'PASS' and review_status = 'PENDING_REVIEW'").select("claim_id", "tier")


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe, analytical = F.col("claim_id") % 13 != 0, F.col("claim_id") % 2 == 0
    joined = with_verdict(spark, sf_dir).withColumn("disposition", rules.disposition(F.coalesce("verdict", F.lit("")), safe, analytical))
    return joined.groupBy("disposition", "review_status").agg(F.count("*").alias("n"))


def claim_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("review_status")
    return claims(spark, sf_dir).groupBy("tier").agg(
        F.count_if(status.isin(*APPROVED)).alias("approved"), F.count_if(status == "PENDING_REVIEW").alias("pending"),
        F.count_if(status == "REJECTED").alias("rejected"), F.max("claim_id").alias("last_claim"),
    )


def hot_alerts(spark: SparkSession, sf_dir: str, least_tier: str = "T3") -> DataFrame:
    """Claims to alert about that no SENT row names yet."""
    sent = verifications(spark, sf_dir).where("verdict = 'CONTRADICTED'").select("claim_id").distinct()
    hot = claims(spark, sf_dir).where((F.col("tier") >= least_tier) & F.col("review_status").isin(*APPROVED))
    return hot.join(sent, "claim_id", "left_anti").select("claim_id", "tier", "review_status")


def narrative_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims approved by hand, then those approved by rule; the first part wins."""
    found = with_verdict(spark, sf_dir).select("claim_id", "review_status", F.coalesce("verdict", F.lit("NONE")).alias("verdict"))
    manual = found.where(F.col("review_status").isin(*rules.MANUAL)).withColumn("route", F.lit("MANUAL"))
    auto = found.where("review_status = 'AUTO_APPROVED' or verdict = 'ENTAILED'").withColumn("route", F.lit("AUTO"))
    return union_by_precedence([manual, auto], ["claim_id"]).select("claim_id", "review_status", "route", "verdict")


def verified_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of verification: approved only when entailed and without entity warnings."""
    warned = F.col("claim_id") % 7 == 0
    verdict = F.when(warned & (F.col("verdict") == "ENTAILED"), "NEUTRAL").otherwise(F.col("verdict"))
    joined = with_verdict(spark, sf_dir, "inner").where("gate_status = 'PASS'").withColumn("verdict", verdict)
    return joined.select("claim_id", "verdict", F.when(F.col("verdict") == "ENTAILED", "AUTO_APPROVED").otherwise("PENDING_REVIEW").alias("status"))


def status_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = spark.createDataFrame([(s,) for s in (*APPROVED, "PENDING_REVIEW", "REJECTED", "PENDING_VERIFICATION")], "review_status string")
    counts = claims(spark, sf_dir).groupBy("review_status").agg(F.count("*").alias("n"))
    return domain.join(counts, "review_status", "left").select("review_status", F.coalesce("n", F.lit(0)).alias("n"))


def without_verdicts_of_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification rows that stay when those of rejected claims are deleted."""
    gone = claims(spark, sf_dir).where("review_status = 'REJECTED'").select("claim_id")
    return verifications(spark, sf_dir).join(gone, "claim_id", "left_anti").groupBy("verdict").agg(F.count("*").alias("n"))


def supersede_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One current claim per document, the latest; the others are superseded."""
    ranked = numbered(claims(spark, sf_dir).where("not superseded"), ["doc_id"], [F.desc("created"), F.desc("claim_id")])
    return ranked.select("claim_id", "doc_id", (F.col("rank") > 1).alias("superseded_now"))


def next_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes for pending claims, numbered per tier after the highest that exists there."""
    base = claims(spark, sf_dir)
    top = base.where("review_status <> 'PENDING_REVIEW'").groupBy("tier").agg(F.max("claim_id").alias("top"))
    pending = numbered_by_range(base.where("review_status = 'PENDING_REVIEW'").select("claim_id", "tier"), ["tier"], ["claim_id"])
    return pending.join(top, "tier").select("claim_id", F.concat_ws("-", "tier", F.lpad((F.col("top") + F.col("rank")).cast("string"), 8, "0")).alias("code"))


def newest_per_tier(spark: SparkSession, sf_dir: str, most: int = 25) -> DataFrame:
    ranked = numbered(claims(spark, sf_dir).select("tier", "claim_id", "created"), ["tier"], [F.desc("created"), F.desc("claim_id")])
    return ranked.where(F.col("rank") <= max(1, min(most, 25))).select("tier", "rank", "claim_id")


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement, precision, recall and F1 of review against verdict, by tier."""
    seen = with_verdict(spark, sf_dir, "inner").select("tier", F.col("review_status").isin(*APPROVED).alias("said"), (F.col("verdict") == "ENTAILED").alias("true"))
    g = seen.groupBy("tier").agg(
        F.count("*").alias("n"), F.count_if(F.col("said") == F.col("true")).alias("agreed"), F.count_if(F.col("said") & F.col("true")).alias("tp"),
        F.count_if(F.col("said") & ~F.col("true")).alias("fp"), F.count_if(~F.col("said") & F.col("true")).alias("fn"),
    )
    rate = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    return g.select("tier", "n", rate(F.col("agreed"), F.col("n")).alias("agreement"), rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


QUERIES = {
    "g01_latest_verdicts": latest_verdicts, "d08_publishable_claims": publishable, "d09_approved_not_contradicted": not_contradicted, "d10_retryable_errors": retryable,
    "m14_dispositions": dispositions, "f25_claim_flow": claim_flow, "b05_hot_alerts": hot_alerts, "i01_narrative_union": narrative_union,
    "e12_verified_status": verified_status, "f03_status_counts": status_zero_filled, "d11_semi_join_delete": without_verdicts_of_rejected,
    "e04_supersede_claims": supersede_older, "e14_next_codes": next_codes, "g20_recent_claims": newest_per_tier, "f27_agreement": agreement,
}

_OK = "('AUTO_APPROVED', 'APPROVED', 'EDITED_APPROVED', 'FORCE_APPROVED')"
_HAND = "('APPROVED', 'EDITED_APPROVED', 'FORCE_APPROVED')"
ORACLE_SQL = {
    "g01_latest_verdicts": with_tables("latest", "SELECT claim_id, verdict FROM latest"),
    "d08_publishable_claims": with_tables("claims latest", f"SELECT claim_id, doc_id, review_status, verdict FROM claims JOIN latest USING (claim_id) WHERE review_status IN {_OK} AND gate_status = 'PASS' AND NOT superseded AND verdict = 'ENTAILED'"),
    "d09_approved_not_contradicted": with_tables("claims latest", f"SELECT claim_id, review_status, coalesce(verdict, 'NONE') AS verdict FROM claims LEFT JOIN latest USING (claim_id) WHERE review_status IN {_OK} AND coalesce(verdict, '') <> 'CONTRADICTED'"),
    "d10_retryable_errors": with_tables("claims latest", "SELECT claim_id, tier FROM claims JOIN latest USING (claim_id) WHERE verdict = 'VERIFIER_ERROR' AND gate_status = 'PASS' AND review_status = 'PENDING_REVIEW'"),
    "m14_dispositions": with_tables("claims latest", f"""SELECT disposition, review_status, count(*) AS n FROM (SELECT review_status, CASE
      WHEN gate_status <> 'PASS' OR superseded OR review_status NOT IN {_OK} OR claim_id % 13 = 0 THEN 'EXCLUDE' WHEN verdict = 'ENTAILED' THEN 'DECISION_GRADE'
      WHEN verdict = 'NEUTRAL' AND review_status IN {_HAND} THEN CASE WHEN claim_id % 2 = 0 THEN 'REVIEWED_ANALYSIS' ELSE 'EDITORIAL_WATCH' END ELSE 'EXCLUDE' END AS disposition
      FROM claims LEFT JOIN latest USING (claim_id)) GROUP BY ALL"""),
    "f25_claim_flow": with_tables("claims", f"SELECT tier, count(*) FILTER (review_status IN {_OK}) AS approved, count(*) FILTER (review_status = 'PENDING_REVIEW') AS pending, count(*) FILTER (review_status = 'REJECTED') AS rejected, max(claim_id) AS last_claim FROM claims GROUP BY tier"),
    "b05_hot_alerts": with_tables("claims checks", f"SELECT claim_id, tier, review_status FROM claims WHERE tier >= 'T3' AND review_status IN {_OK} AND claim_id NOT IN (SELECT claim_id FROM checks WHERE verdict = 'CONTRADICTED')"),
    "i01_narrative_union": with_tables("claims latest", f"""SELECT claim_id, review_status, CASE WHEN review_status IN {_HAND} THEN 'MANUAL' ELSE 'AUTO' END AS route, coalesce(verdict, 'NONE') AS verdict
      FROM claims LEFT JOIN latest USING (claim_id) WHERE review_status IN {_OK} OR verdict = 'ENTAILED'"""),
    "e12_verified_status": with_tables("claims latest", """SELECT claim_id, verdict, CASE WHEN verdict = 'ENTAILED' THEN 'AUTO_APPROVED' ELSE 'PENDING_REVIEW' END AS status FROM
      (SELECT claim_id, CASE WHEN claim_id % 7 = 0 AND verdict = 'ENTAILED' THEN 'NEUTRAL' ELSE verdict END AS verdict FROM claims JOIN latest USING (claim_id) WHERE gate_status = 'PASS')"""),
    "f03_status_counts": with_tables("claims", "SELECT s AS review_status, count(claim_id) AS n FROM (SELECT unnest(['AUTO_APPROVED', 'APPROVED', 'EDITED_APPROVED', 'FORCE_APPROVED', 'PENDING_REVIEW', 'REJECTED', 'PENDING_VERIFICATION']) AS s) LEFT JOIN claims ON s = review_status GROUP BY s"),
    "d11_semi_join_delete": with_tables("claims checks", "SELECT verdict, count(*) AS n FROM checks WHERE claim_id NOT IN (SELECT claim_id FROM claims WHERE review_status = 'REJECTED') GROUP BY verdict"),
    "e04_supersede_claims": with_tables("claims", "SELECT claim_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY created DESC, claim_id DESC) > 1 AS superseded_now FROM claims WHERE NOT superseded"),
    "e14_next_codes": with_tables("claims", """SELECT p.claim_id, p.tier || '-' || lpad(CAST(top + rn AS VARCHAR), 8, '0') AS code FROM (SELECT claim_id, tier, row_number() OVER (PARTITION BY tier ORDER BY claim_id) AS rn FROM claims WHERE review_status = 'PENDING_REVIEW') p
      JOIN (SELECT tier, max(claim_id) AS top FROM claims WHERE review_status <> 'PENDING_REVIEW' GROUP BY tier) t ON p.tier = t.tier"""),
    "g20_recent_claims": with_tables("claims", "SELECT tier, CAST(rn AS INT) AS rank, claim_id FROM (SELECT tier, claim_id, row_number() OVER (PARTITION BY tier ORDER BY created DESC, claim_id DESC) AS rn FROM claims) WHERE rn <= 25"),
    "f27_agreement": with_tables("claims latest", f"""SELECT tier, count(*) AS n, round(count(*) FILTER (said = yes) / count(*), 6) AS agreement, round(coalesce(count(*) FILTER (said AND yes) / nullif(count(*) FILTER (said), 0), 0), 6) AS precision,
      round(coalesce(count(*) FILTER (said AND yes) / nullif(count(*) FILTER (yes), 0), 0), 6) AS recall, round(coalesce(2 * count(*) FILTER (said AND yes) / nullif(count(*) FILTER (said) + count(*) FILTER (yes), 0), 0), 6) AS f1
      FROM (SELECT tier, review_status IN {_OK} AS said, verdict = 'ENTAILED' AS yes FROM claims JOIN latest USING (claim_id)) GROUP BY tier"""),
}
