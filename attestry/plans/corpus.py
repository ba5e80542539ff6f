"""Corpus views, versions and state changes of documents and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import classifications, claims, documents, facts, item_log, run_log, sources, table, verifications, with_tables
from ..domains import APPROVED, AS_OF, AUTHORITIES
from ..functions import rules, text
from ..operators import dictionary
from ..operators.relational import first, latest, numbered, rank_limited

LATEST = ["created", "t1", "t2", "t3"]


def active_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).where("use_policy <> 'ARCHIVE_ONLY'").select("code", "authority", "authority_score", "primary_source", F.coalesce("market", F.lit("NONE")).alias("market"))


def explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its status and its counts of facts, claims and entailed claims."""
    n_facts = facts(spark, sf_dir).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_facts"))
    verdicts = latest(verifications(spark, sf_dir), ["claim_id"], LATEST, ["verdict"])
    n_claims = claims(spark, sf_dir).join(verdicts, "claim_id", "left").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_claims"), F.count_if(F.col("verdict") == "ENTAILED").alias("n_entailed"))
    status = classifications(spark, sf_dir).select(F.col("doc_id").alias("id"), "status")
    docs = documents(spark, sf_dir).select("id", "source_code", "chars")
    joined = docs.join(status, "id", "left").join(n_facts, "id", "left").join(n_claims, "id", "left")
    return joined.select("id", "source_code", "chars", F.coalesce("status", F.lit("NONE")).alias("status"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_facts", "n_claims", "n_entailed")))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).agg(
        F.count("*").alias("docs"), F.count_distinct("content_hash").alias("contents"), F.count_if("full_text").alias("full"), F.count_if(F.col("published_at").isNull()).alias("undated"),
        F.count_if(F.col("parse_status") != "OK").alias("failed"), F.sum("chars").alias("chars"), F.count_distinct("source_code").alias("sources"),
    )


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each document has come: the first of ten states that holds."""
    n_facts = facts(spark, sf_dir).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_facts"))
    v = latest(verifications(spark, sf_dir), ["claim_id"], ["created", "t1", "t2", "t3"], ["verdict"])
    said = claims(spark, sf_dir).join(v, "claim_id", "left").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_claims"), F.count_if(F.col("verdict") == "ENTAILED").alias("n_entailed"))
    status = classifications(spark, sf_dir).select(F.col("doc_id").alias("id"), "status")
    d = documents(spark, sf_dir).select("id", "parse_status", "content_hash")
    firsts = d.groupBy("content_hash").agg(F.min("id").alias("first_id"))
    j = d.join(firsts, "content_hash").join(status, "id", "left").join(n_facts, "id", "left").join(said, "id", "left")
    state = (
        F.when(F.col("parse_status") != "OK", "IMPORT_FAILED").when(F.col("id") != F.col("first_id"), "DUPLICATE").when(F.col("status").isNull(), "WAITING_FOR_CLASSIFICATION").when(F.col("status") == "OUT_OF_SCOPE", "OUT_OF_SCOPE")
        .when(F.col("status") != "CONFIRMED", "HELD_FOR_REVIEW").when(F.col("n_facts").isNull(), "WAITING_FOR_EXTRACTION").when(F.col("n_claims").isNull(), "EVIDENCE_EXTRACTED").when(F.col("n_entailed") == 0, "WAITING_FOR_VERIFICATION")
        .when(F.col("n_entailed") < F.col("n_claims"), "PARTIALLY_VERIFIED").otherwise("REPORT_ELIGIBLE")
    )
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each of six stages may be relied on: passed, with a warning, waiting for another, or stopped."""
    v = latest(verifications(spark, sf_dir), ["claim_id"], ["created", "t1", "t2", "t3"], ["verdict"])
    usable = F.col("full_text") & (F.col("chars") >= 600) & (F.col("parse_status") == "OK")
    c = claims(spark, sf_dir).where(~F.col("superseded")).join(v, "claim_id", "left")
    passed = F.col("gate_status") == "PASS"
    one = (
        documents(spark, sf_dir).agg(F.count("*").alias("docs"), F.count_if(usable).alias("usable"))
        .join(classifications(spark, sf_dir).agg(F.count("*").alias("cls"), F.count_if(F.col("status") == "CONFIRMED").alias("confirmed")))
        .join(item_log(spark, sf_dir).agg(F.count("*").alias("tries"), F.count_if(F.col("status") == "ERROR").alias("failed")))
        .join(facts(spark, sf_dir).agg(F.count("*").alias("facts"), F.count_distinct("doc_id").alias("fact_docs"), F.count_if(F.col("published").isNotNull()).alias("complete"), F.count_if(F.col("fact_type") != "OTHER").alias("routed")))
        .join(c.agg(
            F.count("*").alias("claims"), F.count_distinct("doc_id").alias("claim_docs"), F.count_if(passed).alias("passed"), F.count_if(passed & F.col("verdict").isNotNull()).alias("checked"),
            F.count_if(passed & (F.col("verdict") == "VERIFIER_ERROR")).alias("errors"), F.count_if(passed & (F.col("verdict") == "ENTAILED")).alias("entailed"),
            F.count_if(passed & (F.col("verdict") == "ENTAILED") & F.col("review_status").isin(*APPROVED)).alias("ready"),
        ))
    )
    ratio = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0)
    none = lambda *names: F.greatest(*(F.col(n) == 0 for n in names)) if len(names) > 1 else F.col(names[0]) == 0
    decisions = {
        "ingest": F.when(none("docs", "usable"), "STOP").when(ratio("usable", "docs") < 0.75, "WARN").otherwise("PASS"),
        "classify": F.when(none("cls"), "WAITING").when((ratio("cls", "usable") < 0.5) | none("confirmed"), "STOP").when(ratio("cls", "usable") < 0.9, "WARN").otherwise("PASS"),
        "extract": F.when(none("confirmed", "tries"), "WAITING").when(none("facts"), "STOP").when((ratio("failed", "tries") >= 0.5) | none("complete"), "STOP")
        .when((ratio("fact_docs", "confirmed") < 1) | (ratio("failed", "tries") >= 0.15) | (ratio("complete", "facts") < 0.9) | (ratio("routed", "facts") < 0.9), "WARN").otherwise("PASS"),
        "interpret": F.when(none("facts", "claims"), "WAITING").when(ratio("claim_docs", "confirmed") < 0.9, "WAITING").when(none("passed"), "STOP").when((ratio("claim_docs", "confirmed") < 1) | (ratio("passed", "claims") < 0.35), "WARN").otherwise("PASS"),
        "verify": F.when(none("passed", "checked"), "WAITING").when((ratio("checked", "passed") < 0.5) | (ratio("errors", "checked") >= 0.5), "STOP").when((ratio("checked", "passed") < 0.9) | (ratio("errors", "checked") >= 0.1) | none("entailed"), "WARN").otherwise("PASS"),
        "review": F.when(none("checked", "ready"), "WAITING").otherwise("PASS"),
    }
    return one.select(F.explode(F.array(*(F.struct(F.lit(stage).alias("stage"), decision.alias("decision")) for stage, decision in decisions.items()))).alias("r")).select("r.*")


def upgraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored title-only rows after a second delivery with full texts: one row per URL."""
    docs = documents(spark, sf_dir).select("url", "id", "chars", "full_text", "published_at")
    stored, fresh = docs.where("id % 4 <> 1"), docs.where("id % 2 = 1").withColumn("published_at", F.lit(None).cast("timestamp"))
    both = stored.alias("s").join(fresh.alias("f"), "url", "full_outer")
    takes = F.col("s.id").isNull() | (~F.col("s.full_text") & F.coalesce(F.col("f.full_text"), F.lit(False)))
    return both.select("url", F.coalesce("s.id", "f.id").alias("id"), F.when(takes, F.col("f.chars")).otherwise(F.col("s.chars")).alias("chars"), F.coalesce("s.published_at", "f.published_at").alias("published_at"), F.col("s.id").isNull().alias("added"))


def plan_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the next classification run does with each document."""
    current = classifications(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("version"))
    attempts = item_log(spark, sf_dir).where("stage = 'error'").groupBy(F.col("doc_id").alias("id")).agg(F.max_by("status", F.struct("created", "item_id")).alias("last"))
    d = documents(spark, sf_dir).select("id").join(current, "id", "left").join(attempts, "id", "left")
    action = F.when(F.col("last") == "ERROR", "HOLD_FAILED_VERSION").when(F.col("version").isNull(), "CLASSIFY_NEW").when(F.col("version") != "v2", "RECLASSIFY_STALE").otherwise("SKIP_CURRENT")
    return d.select("id", action.alias("action"))


def swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of applying a new label only where the row is still the one that was read."""
    c = classifications(spark, sf_dir).select("doc_id", "status", (F.col("doc_id") % 5).alias("seen"), (F.col("doc_id") * 3 % 5).alias("now"))
    outcome = F.when(F.col("seen") == 0, "APPLIED_NEW").when(F.col("seen") != F.col("now"), "CONCURRENT_CHANGE_PRESERVED").when(F.col("status") == "NO_LABEL_REVIEW", "PRESERVED_PRIOR_REVIEW").otherwise("APPLIED_REPLACEMENT")
    return c.select("doc_id", outcome.alias("outcome"))


def superseded_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each document's latest run are active; those of older runs, or of none, are not."""
    f = facts(spark, sf_dir).select("code", "doc_id", F.when(F.col("pos") % 7 != 6, F.col("pos") % 3).alias("run"))
    top = f.groupBy("doc_id").agg(F.max("run").alias("current"))
    return f.join(top, "doc_id").select("code", F.coalesce(F.col("run") == F.col("current"), F.lit(False)).alias("active"))


def refetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of fetching documents again, by the first reason that holds."""
    docs = documents(spark, sf_dir).select("id", "full_text", "chars", "content_hash", "source_code")
    twins = docs.groupBy("content_hash").agg(F.count("*").alias("copies"))
    asked = classifications(spark, sf_dir).select((F.col("doc_id") * 2).alias("asked")).distinct()
    j = asked.join(docs, F.col("asked") == F.col("id"), "left").join(twins, "content_hash", "left")
    outcome = (
        F.when(F.col("id").isNull(), "NOT_FOUND").when(F.col("full_text") & (F.col("chars") >= 600), "NOT_ELIGIBLE").when(F.col("source_code") == "src0", "HOST_REJECTED")
        .when(F.col("chars") < 200, "INSUFFICIENT_TEXT").when(F.col("copies") > 1, "DUPLICATE_CONTENT").otherwise("SUCCESS")
    )
    return j.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


#: Phrases of the dictionary, beside the first words of every benchmark item.
LICENCES = ("License", "General Public License", "CC BY-NC 4.0", "All rights reserved.", "anon", "Ere")


def alias_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of a language name an alias as a word: all texts against a dictionary."""
    first = F.regexp_extract("text", r"^\s*([\p{L}\p{N}]+\s[\p{L}\p{N}]+\s[\p{L}\p{N}]+)", 1)
    items = table(spark, sf_dir, "benchmark").select(F.lower(first).alias("alias")).where("alias <> ''")
    aliases = items.union(spark.createDataFrame([(phrase.lower(),) for phrase in LICENCES], "alias string")).distinct()
    hits = dictionary.found(documents(spark, sf_dir).select("lang", "text"), "text", aliases, "alias")
    return hits.groupBy("lang", "alias").agg(F.count("*").alias("n"))


def first_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first(facts(spark, sf_dir), ["doc_id"], ["pos"], ["code"])


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their run and document; items of unknown documents drop out."""
    from ..operators.relational import as_of

    items = as_of(item_log(spark, sf_dir), run_log(spark, sf_dir), "created", "started", "run_id")
    docs = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "lang")
    return items.where("run_id is not null").join(docs, "doc_id").groupBy("run_id", "lang").agg(F.count("*").alias("n"))


def executive_rounds(spark: SparkSession, sf_dir: str, most: int = 20) -> DataFrame:
    """Facts taken in turns over documents: every document's first, then every second one."""
    ranked = numbered(facts(spark, sf_dir).select("doc_id", "code"), ["doc_id"], [F.col("code")])
    return ranked.orderBy("rank", "doc_id").limit(most).select("doc_id", "code", "rank")


def narrative_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two claims a document, documents with the newest claims first, 24 in all."""
    c = claims(spark, sf_dir).where(F.col("review_status").isin(*APPROVED)).select("claim_id", "doc_id", "created")
    top = rank_limited(c, ["doc_id"], [F.desc("created"), F.col("claim_id")], 2)
    newest = c.groupBy("doc_id").agg(F.max("created").alias("newest"))
    return top.join(newest, "doc_id").orderBy(F.desc("newest"), "doc_id", F.desc("created"), "claim_id").limit(24).select("claim_id", "doc_id")


def pages_of_lines(spark: SparkSession, sf_dir: str, budget: int = 1_500) -> DataFrame:
    """Facts of a document laid on pages: a page is full when the next fact would not fit."""
    row = F.struct("pos", F.length("span").cast("long").alias("size"), "code")
    each = facts(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("page"), F.lit(0).cast("long").alias("used"))
    fits = lambda s, r: (s["used"] == 0) | (s["used"] + r["size"] <= budget)
    step = lambda s, r: F.struct(F.when(fits(s, r), s["page"]).otherwise(s["page"] + 1).alias("page"), F.when(fits(s, r), s["used"] + r["size"]).otherwise(r["size"]).alias("used"))
    return each.select("doc_id", F.size("rows").alias("n"), (F.aggregate("rows", start, step)["page"] + 1).alias("pages"))


def attribution_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    marks = F.array_compact(F.array(
        F.when(~rules.attribution_safe(), "UNSAFE_ENTITY"), F.when(F.col("company").isNotNull() & ~F.contains("span", F.col("company")), "COMPANY_NOT_IN_SPAN"),
        F.when(F.col("published").isNull(), "UNDATED"), F.when(F.col("expiry") < F.col("effective"), "BAD_RANGE"), F.when(~F.col("full_text"), "TITLE_ONLY"),
    ))
    return f.select(F.explode(marks).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


def downgraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts shown as decisions or only to watch, by what their source may support."""
    s = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "use_policy", "authority_score")
    f = facts(spark, sf_dir).select("code", "source_code", "company").join(s, "source_code")
    many = f.where("company is not null").groupBy("company").agg(F.count_distinct("source_code").alias("n"))
    weak = (F.col("authority_score") < 58) & (F.coalesce("n", F.lit(1)) < 2)
    show = F.when((F.col("use_policy") != "DECISION_ELIGIBLE") | weak, "WATCH").otherwise("DECISION")
    return f.join(many, "company", "left").groupBy(show.alias("shown_as"), "use_policy").agg(F.count("*").alias("n"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), " · ")
    return facts(spark, sf_dir).groupBy("doc_id").agg(joined.alias("codes"))


def overlap_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal spans of one type in a document."""
    return first(facts(spark, sf_dir), ["doc_id", "fact_type", "span"], ["pos"], ["code"]).select("doc_id", "fact_type", "code")


def authority_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by authority in declaration order, kinds without a source at zero."""
    domain = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(AUTHORITIES)], "ordinal int, authority string")
    n = sources(spark, sf_dir).groupBy("authority").agg(F.count("*").alias("n"))
    return domain.join(n, "authority", "left").select("ordinal", "authority", F.coalesce("n", F.lit(0)).alias("n"))


def replay_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that a run must make: those whose prompt and sample have no stored answer yet."""
    calls = documents(spark, sf_dir).select("id", F.sha2(F.concat_ws("\n", F.lit("prompt"), "content_hash"), 256).alias("prompt_sha"), F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("sample"))
    stored = calls.where("id % 5 = 0").select("prompt_sha", "sample").distinct()
    return calls.join(stored, ["prompt_sha", "sample"], "left_anti").groupBy("sample").agg(F.count("*").alias("calls"), F.count_distinct("prompt_sha").alias("prompts"))


def dated_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next date ahead of each fact, and its age band."""
    day = F.lit(AS_OF).cast("date")
    ahead = F.least(*(F.when(F.col(c) > day, F.col(c)) for c in ("effective", "expiry", "forecast")))
    return facts(spark, sf_dir).select("code", ahead.alias("next_date"), rules.freshness(rules.age_days(F.col("published"), AS_OF)).alias("freshness"))


def folded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("lang in ('fr', 'es')").select("id", F.regexp_replace(rules.folded(F.col("title")), "[^a-z ]", "").alias("folded"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("roles"), F.sum(F.length("text")).alias("chars"), F.max_by("role", "turn").alias("last_role"))


QUERIES = {
    "a01_active_sources": active_sources, "d23_corpus_explorer": explorer, "f26_corpus_summary": summary, "m25_lifecycle": lifecycle, "m23_checkpoint": checkpoint, "b02_upgrade_in_place": upgraded,
    "e08_plan_actions": plan_actions, "e09_compare_and_set": swapped, "e01_supersede_facts": superseded_facts, "e17_refetch_outcomes": refetch_outcomes, "d24_alias_hits": alias_hits, "d26_first_codes": first_codes,
    "d22_item_history": history, "g07_executive_rounds": executive_rounds, "g15_narrative_picks": narrative_picks, "g13_pagination": pages_of_lines, "m09_fact_marks": attribution_warnings,
    "m16_downgrade": downgraded, "f35_reference_list": references, "k53_overlap_free": overlap_free, "h07_authority_order": authority_names, "j07_replay_cache": replay_cache, "k42_next_dates": dated_kinds,
    "k03_accent_fold": folded_titles, "f01_conversations": conversations,
}

_OK = "('AUTO_APPROVED', 'APPROVED', 'EDITED_APPROVED', 'FORCE_APPROVED')"
ORACLE_SQL = {
    "a01_active_sources": with_tables("src", "SELECT code, authority, authority_score, primary_source, coalesce(market, 'NONE') AS market FROM src WHERE use_policy <> 'ARCHIVE_ONLY'"),
    "d23_corpus_explorer": with_tables("facts claims latest", """SELECT d.id, source_code, chars, coalesce(status, 'NONE') AS status, coalesce(n_facts, 0) AS n_facts, coalesce(n_claims, 0) AS n_claims, coalesce(n_entailed, 0) AS n_entailed FROM docs d LEFT JOIN cls ON cls.doc_id = d.id
      LEFT JOIN (SELECT doc_id, count(*) AS n_facts FROM facts GROUP BY doc_id) f ON f.doc_id = d.id LEFT JOIN (SELECT doc_id, count(*) AS n_claims, count(*) FILTER (verdict = 'ENTAILED') AS n_entailed FROM claims LEFT JOIN latest USING (claim_id) GROUP BY doc_id) c ON c.doc_id = d.id"""),
    "f26_corpus_summary": with_tables("docs", "SELECT count(*) AS docs, count(DISTINCT content_hash) AS contents, count(*) FILTER (full_text) AS full, count(*) FILTER (published_at IS NULL) AS undated, count(*) FILTER (parse_status <> 'OK') AS failed, CAST(sum(chars) AS BIGINT) AS chars, count(DISTINCT source_code) AS sources FROM docs"),
    "m25_lifecycle": with_tables("facts claims latest", """SELECT CASE WHEN parse_status <> 'OK' THEN 'IMPORT_FAILED' WHEN id <> first_id THEN 'DUPLICATE' WHEN status IS NULL THEN 'WAITING_FOR_CLASSIFICATION' WHEN status = 'OUT_OF_SCOPE' THEN 'OUT_OF_SCOPE' WHEN status <> 'CONFIRMED' THEN 'HELD_FOR_REVIEW'
      WHEN nf IS NULL THEN 'WAITING_FOR_EXTRACTION' WHEN nc IS NULL THEN 'EVIDENCE_EXTRACTED' WHEN ne = 0 THEN 'WAITING_FOR_VERIFICATION' WHEN ne < nc THEN 'PARTIALLY_VERIFIED' ELSE 'REPORT_ELIGIBLE' END AS state, count(*) AS n
      FROM (SELECT id, parse_status, min(id) OVER (PARTITION BY content_hash) AS first_id FROM docs) d LEFT JOIN cls c ON c.doc_id = d.id LEFT JOIN (SELECT doc_id, count(*) AS nf FROM facts GROUP BY doc_id) f ON f.doc_id = d.id
      LEFT JOIN (SELECT doc_id, count(*) AS nc, count(*) FILTER (verdict = 'ENTAILED') AS ne FROM claims LEFT JOIN latest USING (claim_id) GROUP BY doc_id) q ON q.doc_id = d.id GROUP BY ALL"""),
    "m23_checkpoint": with_tables("facts claims latest items", f"""also c AS (SELECT c.*, verdict FROM claims c LEFT JOIN latest USING (claim_id) WHERE NOT superseded), o AS (SELECT (SELECT count(*) FROM docs) AS docs, (SELECT count(*) FROM docs WHERE full_text AND chars >= 600 AND parse_status = 'OK') AS usable,
      (SELECT count(*) FROM cls) AS cls, (SELECT count(*) FROM cls WHERE status = 'CONFIRMED') AS confirmed, (SELECT count(*) FROM items) AS tries, (SELECT count(*) FROM items WHERE status = 'ERROR') AS failed, (SELECT count(*) FROM facts) AS facts, (SELECT count(DISTINCT doc_id) FROM facts) AS fact_docs,
      (SELECT count(published) FROM facts) AS complete, (SELECT count(*) FROM facts WHERE fact_type <> 'OTHER') AS routed, (SELECT count(*) FROM c) AS claims, (SELECT count(DISTINCT doc_id) FROM c) AS claim_docs, (SELECT count(*) FROM c WHERE gate_status = 'PASS') AS passed,
      (SELECT count(verdict) FROM c WHERE gate_status = 'PASS') AS checked, (SELECT count(*) FROM c WHERE gate_status = 'PASS' AND verdict = 'VERIFIER_ERROR') AS errors, (SELECT count(*) FROM c WHERE gate_status = 'PASS' AND verdict = 'ENTAILED') AS entailed,
      (SELECT count(*) FROM c WHERE gate_status = 'PASS' AND verdict = 'ENTAILED' AND review_status IN {_OK}) AS ready)
      SELECT 'ingest' AS stage, CASE WHEN usable = 0 THEN 'STOP' WHEN usable < 0.75 * docs THEN 'WARN' ELSE 'PASS' END AS decision FROM o UNION ALL
      SELECT 'classify', CASE WHEN cls = 0 THEN 'WAITING' WHEN cls < 0.5 * usable OR confirmed = 0 THEN 'STOP' WHEN cls < 0.9 * usable THEN 'WARN' ELSE 'PASS' END FROM o UNION ALL
      SELECT 'extract', CASE WHEN confirmed = 0 OR tries = 0 THEN 'WAITING' WHEN facts = 0 OR failed >= 0.5 * tries OR complete = 0 THEN 'STOP' WHEN fact_docs < confirmed OR failed >= 0.15 * tries OR complete < 0.9 * facts OR routed < 0.9 * facts THEN 'WARN' ELSE 'PASS' END FROM o UNION ALL
      SELECT 'interpret', CASE WHEN facts = 0 OR claims = 0 OR claim_docs < 0.9 * confirmed THEN 'WAITING' WHEN passed = 0 THEN 'STOP' WHEN claim_docs < confirmed OR passed < 0.35 * claims THEN 'WARN' ELSE 'PASS' END FROM o UNION ALL
      SELECT 'verify', CASE WHEN passed = 0 OR checked = 0 THEN 'WAITING' WHEN checked < 0.5 * passed OR errors >= 0.5 * checked THEN 'STOP' WHEN checked < 0.9 * passed OR errors >= 0.1 * checked OR entailed = 0 THEN 'WARN' ELSE 'PASS' END FROM o UNION ALL
      SELECT 'review', CASE WHEN checked = 0 OR ready = 0 THEN 'WAITING' ELSE 'PASS' END FROM o"""),
    "b02_upgrade_in_place": with_tables("docs", """SELECT url, id, chars, CASE WHEN id % 4 <> 1 THEN published_at END AS published_at, id % 4 = 1 AS added FROM docs"""),
    "e08_plan_actions": with_tables("docs cls items", """SELECT id, CASE WHEN last = 'ERROR' THEN 'HOLD_FAILED_VERSION' WHEN c.doc_id IS NULL THEN 'CLASSIFY_NEW' WHEN c.doc_id % 3 <> 2 THEN 'RECLASSIFY_STALE' ELSE 'SKIP_CURRENT' END AS action FROM docs LEFT JOIN cls c ON c.doc_id = id
      LEFT JOIN (SELECT doc_id, status AS last FROM items WHERE stage = 'error' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY created DESC, item_id DESC) = 1) a ON a.doc_id = id"""),
    "e09_compare_and_set": with_tables("cls", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'APPLIED_NEW' WHEN doc_id % 5 <> doc_id * 3 % 5 THEN 'CONCURRENT_CHANGE_PRESERVED' WHEN status = 'NO_LABEL_REVIEW' THEN 'PRESERVED_PRIOR_REVIEW' ELSE 'APPLIED_REPLACEMENT' END AS outcome FROM cls"),
    "e01_supersede_facts": with_tables("facts", "SELECT code, coalesce(run = max(run) OVER (PARTITION BY doc_id), false) AS active FROM (SELECT code, doc_id, CASE WHEN pos % 7 <> 6 THEN pos % 3 END AS run FROM facts)"),
    "e17_refetch_outcomes": with_tables("docs cls", """SELECT CASE WHEN id IS NULL THEN 'NOT_FOUND' WHEN full_text AND chars >= 600 THEN 'NOT_ELIGIBLE' WHEN source_code = 'src0' THEN 'HOST_REJECTED' WHEN chars < 200 THEN 'INSUFFICIENT_TEXT' WHEN copies > 1 THEN 'DUPLICATE_CONTENT' ELSE 'SUCCESS' END AS outcome, count(*) AS n
      FROM (SELECT DISTINCT doc_id * 2 AS asked FROM cls) LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY content_hash) AS copies FROM docs) ON id = asked GROUP BY ALL"""),
    "d24_alias_hits": with_tables("docs", f"""also a AS (SELECT DISTINCT alias, regexp_replace(alias, '([^\\p{{L}}\\p{{N}} ])', '\\\\\\1', 'g') AS pattern FROM (SELECT lower(regexp_extract(text, '^\\s*([\\p{{L}}\\p{{N}}]+\\s[\\p{{L}}\\p{{N}}]+\\s[\\p{{L}}\\p{{N}}]+)', 1)) AS alias FROM benchmark UNION ALL SELECT unnest({[x.lower() for x in LICENCES]})) WHERE alias <> ''),
      t AS (SELECT lang, lower(text) AS t FROM docs), near AS MATERIALIZED (SELECT * FROM t, a WHERE contains(t, alias))
      SELECT lang, alias, count(*) AS n FROM near WHERE regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}])' || pattern || '($|[^\\p{{L}}\\p{{N}}])') GROUP BY lang, alias"""),
    "d26_first_codes": with_tables("facts", "SELECT doc_id, min(code) AS code FROM facts GROUP BY doc_id"),
    "d22_item_history": with_tables("docs items runs", "SELECT run_id, lang, count(*) AS n FROM (SELECT * FROM items ASOF JOIN runs ON started <= created) i JOIN docs ON id = doc_id GROUP BY ALL"),
    "g07_executive_rounds": with_tables("facts", "SELECT doc_id, code, CAST(rn AS INT) AS rank FROM (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY code) AS rn FROM facts) ORDER BY rn, doc_id LIMIT 20"),
    "g15_narrative_picks": with_tables("claims", f"SELECT claim_id, doc_id FROM (SELECT *, max(created) OVER (PARTITION BY doc_id) AS newest FROM claims WHERE review_status IN {_OK} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY created DESC, claim_id) <= 2) ORDER BY newest DESC, doc_id, created DESC, claim_id LIMIT 24"),
    "g13_pagination": with_tables("facts", """also RECURSIVE_ROWS AS (SELECT doc_id, CAST(length(span) AS BIGINT) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM facts), walk AS (SELECT doc_id, k, size AS used, CAST(0 AS BIGINT) AS page FROM RECURSIVE_ROWS WHERE k = 1
      UNION ALL SELECT r.doc_id, r.k, CASE WHEN used + r.size <= 1500 THEN used + r.size ELSE r.size END, CASE WHEN used + r.size <= 1500 THEN page ELSE page + 1 END FROM walk w JOIN RECURSIVE_ROWS r ON r.doc_id = w.doc_id AND r.k = w.k + 1)
      SELECT doc_id, CAST(count(*) AS INT) AS n, max(page) + 1 AS pages FROM walk GROUP BY doc_id""").replace("WITH ", "WITH RECURSIVE ", 1),
    "m09_fact_marks": with_tables("facts", """SELECT warning, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT (entity_status = 'RESOLVED' OR company IS NULL) THEN 'UNSAFE_ENTITY' END, CASE WHEN NOT contains(span, company) THEN 'COMPANY_NOT_IN_SPAN' END, CASE WHEN published IS NULL THEN 'UNDATED' END,
      CASE WHEN expiry < effective THEN 'BAD_RANGE' END, CASE WHEN NOT full_text THEN 'TITLE_ONLY' END]) AS warning FROM facts) WHERE warning IS NOT NULL GROUP BY warning"""),
    "m16_downgrade": with_tables("facts src", """SELECT CASE WHEN use_policy <> 'DECISION_ELIGIBLE' OR (authority_score < 58 AND coalesce(m.n, 1) < 2) THEN 'WATCH' ELSE 'DECISION' END AS shown_as, use_policy, count(*) AS n FROM facts f JOIN src s ON s.code = source_code
      LEFT JOIN (SELECT company, count(DISTINCT source_code) AS n FROM facts WHERE company IS NOT NULL GROUP BY company) m ON m.company = f.company GROUP BY ALL"""),
    "f35_reference_list": with_tables("facts", "SELECT doc_id, string_agg(code, ' · ' ORDER BY pos) AS codes FROM facts GROUP BY doc_id"),
    "k53_overlap_free": with_tables("facts", "SELECT doc_id, fact_type, min(code) AS code FROM facts GROUP BY doc_id, fact_type, span"),
    "h07_authority_order": with_tables("src", "SELECT CAST(k AS INT) AS ordinal, a AS authority, count(code) AS n FROM (VALUES " + ", ".join(f"({k}, '{a}')" for k, (a, _) in enumerate(AUTHORITIES)) + ") v(k, a) LEFT JOIN src ON authority = a GROUP BY k, a"),
    "j07_replay_cache": with_tables("docs", "SELECT CAST(k AS INT) AS sample, count(*) AS calls, count(DISTINCT content_hash) AS prompts FROM docs, range(3) r(k) WHERE content_hash NOT IN (SELECT content_hash FROM docs WHERE id % 5 = 0) GROUP BY k"),
    "k42_next_dates": with_tables("facts", """SELECT code, least(CASE WHEN effective > DATE '2026-08-06' THEN effective END, CASE WHEN expiry > DATE '2026-08-06' THEN expiry END, CASE WHEN forecast > DATE '2026-08-06' THEN forecast END) AS next_date,
      CASE WHEN age <= 7 THEN 15 WHEN age <= 30 THEN 12 WHEN age <= 90 THEN 8 WHEN age <= 180 THEN 4 ELSE 1 END AS freshness FROM (SELECT *, coalesce(greatest(DATE '2026-08-06' - published, 0), 0) AS age FROM facts)"""),
    "k03_accent_fold": with_tables("docs", "SELECT id, regexp_replace(replace(strip_accents(lower(title)), 'đ', 'd'), '[^a-z ]', '', 'g') AS folded FROM docs WHERE lang IN ('fr', 'es')"),
    "f01_conversations": "SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id",
}
