"""Review actions, audits of sources, parsed model answers and grouped findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import claims, documents, facts, sources, table, verifications, with_tables
from ..domains import CATEGORIES
from ..functions import rules, text
from ..operators.relational import rank_limited


def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each claim after its actions in order; approved and rejected are final.

    A claim's actions are few, so they are folded as one array per claim.
    """
    action = F.when(F.col("verdict") == "ENTAILED", "APPROVE").when(F.col("verdict") == "CONTRADICTED", "REJECT").when(F.col("verdict") == "NEUTRAL", "EDIT").otherwise("NONE")
    steps = verifications(spark, sf_dir).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("created", "t1", "t2", "t3", action.alias("action")))).alias("steps"))
    final = lambda s: s.isin("APPROVED", "REJECTED")
    move = lambda s, a: (
        F.when(final(s), s).when((a["action"] == "APPROVE") & (s == "PENDING_VERIFICATION"), "PENDING_REVIEW").when(a["action"] == "APPROVE", "APPROVED")
        .when(a["action"] == "REJECT", "REJECTED").when(a["action"] == "EDIT", "PENDING_VERIFICATION").otherwise(s)
    )
    return steps.select("claim_id", F.aggregate("steps", F.lit("PENDING_REVIEW"), move).alias("state"), F.size("steps").alias("n_actions"))


def action_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a review action is refused, by the first guard that fails."""
    c = claims(spark, sf_dir).select("claim_id", "review_status", "gate_status", (F.col("claim_id") % 12).alias("reason_length"), (F.col("claim_id") % 3).alias("n_citations"))
    refusal = (
        F.when(F.col("review_status") != "PENDING_REVIEW", "NOT_PENDING").when(F.col("n_citations") == 0, "CITATION_REQUIRED").when((F.col("gate_status") != "PASS") & (F.col("reason_length") < 10), "FORCE_REASON_TOO_SHORT")
        .when(F.col("reason_length") < 5, "REASON_TOO_SHORT").otherwise("ALLOWED")
    )
    return c.groupBy(refusal.alias("refusal")).agg(F.count("*").alias("n"))


def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each page URL as a source, by the first rule that holds."""
    known = documents(spark, sf_dir).select("url").distinct().withColumn("known", F.lit(True))
    p = table(spark, sf_dir, "pages").select("page_id", "url").join(known, "url", "left")
    status = (
        F.when(rules.https_problem(F.col("url")).isin("EMPTY", "TOO_LONG", "NOT_HTTPS", "NO_HOST"), "INVALID").when(F.col("known"), "ALREADY_REGISTERED").when(rules.https_problem(F.col("url")).isNotNull(), "FETCH_REJECTED")
        .when(F.col("url").rlike(r"(?i)\.pdf($|\?)"), "IMPORT_AS_DOCUMENT").when(F.col("url").rlike("(?i)(rss|feed|atom)"), "REVIEW_FOR_RECURRING_SOURCE").otherwise("NEEDS_DEDICATED_PARSER")
    )
    return p.select("page_id", status.alias("status"))


def label_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a model's JSON answers; one label outside the closed list rejects the answer."""
    made = documents(spark, sf_dir).select("id", F.to_json(F.struct(F.array(F.element_at(F.array(*(F.lit(c) for c in CATEGORIES)), (F.col("id") % 15 + 1).cast("int")), F.when(F.col("id") % 7 == 0, "UNHEARD_OF").otherwise("SALES_DATA")).alias("labels"))).alias("answer"))
    labels = F.from_json("answer", "labels array<string>")["labels"]
    valid = F.forall(labels, lambda x: x.isin(*CATEGORIES))
    return made.select("id", F.when(valid, F.array_join(labels, ",")).otherwise("").alias("labels"))


def fact_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by why they are rejected: the span must stand in the text, names in the span."""
    docs = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "text")
    f = facts(spark, sf_dir).withColumn("span", F.when(F.col("pos") % 6 == 5, F.concat("span", F.lit("?!"))).otherwise(F.col("span"))).join(docs, "doc_id")
    reason = F.when(~F.contains("text", F.col("span")), "SPAN_NOT_VERBATIM").when(F.length("span") > 600, "SPAN_TOO_LONG").when(F.col("published").isNull(), "UNDATED").otherwise("KEPT")
    return f.groupBy("fact_type", reason.alias("reason")).agg(F.count("*").alias("n"))


def refetch_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    short = F.col("chars") < 600
    return d.groupBy("intake").agg(F.count("*").alias("n"), F.count_if(~F.col("full_text")).alias("unverified"), F.count_if(F.col("full_text") & short).alias("short"), F.count_if(F.col("full_text") & ~short).alias("fine"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by bucket with their first five codes, longest spans first."""
    f = facts(spark, sf_dir).select("fact_type", "code", F.length("span").alias("len"))
    top = rank_limited(f, ["fact_type"], [F.desc("len"), F.col("code")], 5)
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("len")).alias("l"), "code"))), lambda x: x["code"]), ",")
    return f.groupBy("fact_type").agg(F.count("*").alias("n")).join(top.groupBy("fact_type").agg(codes.alias("codes")), "fact_type")


def by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that failed a gate, highest tier first within a document, numbered."""
    from ..operators.relational import numbered

    c = claims(spark, sf_dir).where("gate_status <> 'PASS'").select("doc_id", "claim_id", "tier")
    return numbered(c, ["doc_id"], [F.desc("tier"), F.col("claim_id")]).select("doc_id", "claim_id", "tier", "rank")


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents per content from distinct sources, the best source first."""
    s = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "authority_score")
    d = documents(spark, sf_dir).select("id", "content_hash", "source_code").join(s, "source_code")
    one = rank_limited(d, ["content_hash", "source_code"], [F.col("id")], 1)
    return rank_limited(one, ["content_hash"], [F.desc("authority_score"), F.col("id")], 2).select("content_hash", "id")


def evidence_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text around each fact's span."""
    docs = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "text")
    x = facts(spark, sf_dir).select("code", "doc_id", F.substring("span", 1, 30).alias("span")).join(docs, "doc_id").select("code", text.around(F.col("text"), F.col("span"), 20).alias("x"))
    return x.select("code", "x.before", "x.after", "x.found")


def plain_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold any of some terms, by plain substring."""
    d = documents(spark, sf_dir).select("lang", rules.any_contains(F.lower("text"), ("license", "licence", "rights reserved")).alias("hit"))
    return d.groupBy("lang").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))


QUERIES = {
    "e11_review_states": review_states, "c24_action_guards": action_guards, "c29_source_audit": source_audit, "k25_label_answers": label_answers, "k52_fact_gate": fact_gate, "f10_refetch_funnel": refetch_funnel,
    "f13_findings": findings, "c08_by_gate_status": by_status, "g10_representatives": representatives, "k20_evidence_around": evidence_around, "k22_plain_terms": plain_terms,
}

ORACLE_SQL = {
    "e11_review_states": with_tables("checks", """also numbered AS (SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY created, t1, t2, t3) AS k, verdict FROM checks),
      walk AS (SELECT DISTINCT claim_id, CAST(0 AS BIGINT) AS k, 'PENDING_REVIEW' AS state FROM checks UNION ALL SELECT n.claim_id, n.k, CASE WHEN state IN ('APPROVED', 'REJECTED') THEN state WHEN verdict = 'ENTAILED' AND state = 'PENDING_VERIFICATION' THEN 'PENDING_REVIEW'
        WHEN verdict = 'ENTAILED' THEN 'APPROVED' WHEN verdict = 'CONTRADICTED' THEN 'REJECTED' WHEN verdict = 'NEUTRAL' THEN 'PENDING_VERIFICATION' ELSE state END FROM walk w JOIN numbered n ON n.claim_id = w.claim_id AND n.k = w.k + 1)
      SELECT claim_id, arg_max(state, k) AS state, CAST(max(k) AS INT) AS n_actions FROM walk GROUP BY claim_id""").replace("WITH ", "WITH RECURSIVE ", 1),
    "c24_action_guards": with_tables("claims", "SELECT CASE WHEN review_status <> 'PENDING_REVIEW' THEN 'NOT_PENDING' WHEN claim_id % 3 = 0 THEN 'CITATION_REQUIRED' WHEN gate_status <> 'PASS' AND claim_id % 12 < 10 THEN 'FORCE_REASON_TOO_SHORT' WHEN claim_id % 12 < 5 THEN 'REASON_TOO_SHORT' ELSE 'ALLOWED' END AS refusal, count(*) AS n FROM claims GROUP BY ALL"),
    "c29_source_audit": with_tables("docs", """SELECT page_id, CASE WHEN NOT starts_with(p.url, 'https://') OR length(p.url) > 1000 THEN 'INVALID' WHEN p.url IN (SELECT url FROM docs) THEN 'ALREADY_REGISTERED' WHEN contains(p.url, '#') OR contains(p.url, '@') OR regexp_extract(p.url, '^https://[^/?#]*:([0-9]+)', 1) NOT IN ('', '443') THEN 'FETCH_REJECTED'
      WHEN regexp_matches(p.url, '(?i)\\.pdf($|\\?)') THEN 'IMPORT_AS_DOCUMENT' WHEN regexp_matches(p.url, '(?i)(rss|feed|atom)') THEN 'REVIEW_FOR_RECURRING_SOURCE' ELSE 'NEEDS_DEDICATED_PARSER' END AS status FROM pages p"""),
    "k25_label_answers": "SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE [" + ", ".join(f"'{c}'" for c in CATEGORIES) + "][doc_id % 15 + 1] || ',SALES_DATA' END AS labels FROM documents",
    "k52_fact_gate": with_tables("facts", """SELECT fact_type, CASE WHEN NOT contains(text, s) THEN 'SPAN_NOT_VERBATIM' WHEN length(s) > 600 THEN 'SPAN_TOO_LONG' WHEN f.published IS NULL THEN 'UNDATED' ELSE 'KEPT' END AS reason, count(*) AS n
      FROM (SELECT *, CASE WHEN pos % 6 = 5 THEN span || '?!' ELSE span END AS s FROM facts) f JOIN docs ON id = doc_id GROUP BY ALL"""),
    "f10_refetch_funnel": with_tables("docs", "SELECT intake, count(*) AS n, count(*) FILTER (NOT full_text) AS unverified, count(*) FILTER (full_text AND chars < 600) AS short, count(*) FILTER (full_text AND chars >= 600) AS fine FROM docs GROUP BY intake"),
    "f13_findings": with_tables("facts", "SELECT fact_type, count(*) AS n, string_agg(CASE WHEN rn <= 5 THEN code END, ',' ORDER BY rn) AS codes FROM (SELECT *, row_number() OVER (PARTITION BY fact_type ORDER BY length(span) DESC, code) AS rn FROM facts) GROUP BY fact_type"),
    "c08_by_gate_status": with_tables("claims", "SELECT doc_id, claim_id, tier, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tier DESC, claim_id) AS INT) AS rank FROM claims WHERE gate_status <> 'PASS'"),
    "g10_representatives": with_tables("docs src", "SELECT content_hash, id FROM (SELECT content_hash, id, authority_score FROM docs JOIN src ON code = source_code QUALIFY row_number() OVER (PARTITION BY content_hash, source_code ORDER BY id) = 1) QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY authority_score DESC, id) <= 2"),
    "k20_evidence_around": with_tables("facts", """SELECT code, CASE WHEN p > 0 THEN substr(text, greatest(p - 20, 1), p - greatest(p - 20, 1)) END AS before, CASE WHEN p > 0 THEN substr(text, p + length(s), 20) END AS after, p > 0 AS found
      FROM (SELECT code, text, substr(span, 1, 30) AS s, strpos(text, substr(span, 1, 30)) AS p FROM facts JOIN docs ON id = doc_id)"""),
    "k22_plain_terms": with_tables("docs", "SELECT lang, count(*) FILTER (regexp_matches(lower(text), 'license|licence|rights reserved')) AS hits, count(*) AS n FROM docs GROUP BY lang"),
}
