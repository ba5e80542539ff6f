"""Scans, joins, set operations, orders and small functions of the data model, one query each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import classifications, claims, documents, facts, item_log, routing, run_log, sources, table, verifications, with_tables
from ..domains import APPROVED, AS_OF, CATEGORIES, GATES, ZONE
from ..functions import rules, text
from ..operators.relational import first, latest, numbered_by_range, union_by_precedence
from ..sources import web
from ..storage import scratch

LATEST = ["created", "t1", "t2", "t3"]


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def sources_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their place by authority and code."""
    s = sources(spark, sf_dir).select("code", F.lit(0).alias("all"), (-F.col("authority_score")).alias("lesser"))
    return numbered_by_range(s, ["all"], ["lesser", "code"], "place").select("code", (F.col("place") - 1).alias("place"))


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over the active sources stored and what failed; errors become rows, not exceptions."""
    active = sources(spark, sf_dir).where("use_policy <> 'ARCHIVE_ONLY'").select(F.col("code").alias("source_code"))
    g = documents(spark, sf_dir).join(active, "source_code").groupBy("source_code").agg(F.count_if(F.col("parse_status") == "OK").alias("ok"), F.count_if(F.col("parse_status") != "OK").alias("failed"))
    return g.withColumn("summary", F.concat_ws(" ", "source_code", F.concat(F.lit("ok="), "ok"), F.when(F.col("failed") > 0, F.concat(F.lit("failed="), "failed"))))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = web.plain(web.without_elements(F.col("html"), ("script", "style")))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(t, 256).alias("text_sha"), F.length(t).cast("long").alias("chars"))


def with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source; the audit form keeps documents without one."""
    s = sources(spark, sf_dir).where("n % 13 <> 5").select(F.col("code").alias("source_code"), "authority")
    return documents(spark, sf_dir).select("id", "source_code").join(s, "source_code", "left").groupBy(F.coalesce("authority", F.lit("NO_SOURCE")).alias("authority")).agg(F.count("*").alias("n"))


def pasted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first https address of each pasted line, once, with a type from its ending."""
    lines = F.concat_ws("\n", F.concat(F.lit("see https://a.example/"), "doc_id", F.lit(".pdf).")), F.concat(F.lit("https://a.example/"), "doc_id", F.lit(".pdf again")), F.lit("no link"), F.concat(F.lit("RSS https://b.example/feed/"), F.col("doc_id") % 7, F.lit(",")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(web.pasted_links(lines)).alias("pos", "link"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "link", F.when(F.col("link").endswith(".pdf"), "PDF").otherwise("HTML").alias("kind"))


def failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that could not be read, stored with a hash of their address in place of their text."""
    bad = documents(spark, sf_dir).where("parse_status <> 'OK'")
    return bad.select("id", "parse_status", F.sha2(F.concat(F.lit("failed:"), "url"), 256).alias("content_hash"), F.lit("").alias("text"))


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as lines of CSV, text columns in quotes with inner quotes doubled."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return documents(spark, sf_dir).select("id", F.concat_ws(",", F.col("id").cast("string"), quoted(F.col("title")), quoted(F.col("source_code")), quoted(F.col("url"))).alias("line"))


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item log after a run appended its rows: nothing that was there changes."""
    log = item_log(spark, sf_dir).select("item_id", "stage", "status")
    again = log.where("status = 'ERROR'").select("item_id", F.lit("retry").alias("stage"), F.lit("OK").alias("status"))
    return log.unionByName(again).groupBy("stage", "status").agg(F.count("*").alias("n"))


def cache_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as rows of the replay cache: hash of the prompt, number of the sample, reply."""
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    key = F.sha2(F.concat_ws("\n", F.lit("model-a"), F.col("conv_id").cast("string")), 256)
    return t.select(key.alias("prompt_sha"), F.col("turn").cast("long").alias("sample"), F.length("text").cast("long").alias("reply_chars"))


def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edition per cadence from the same documents."""
    days = spark.createDataFrame([(7,), (30,), (90,)], "days int")
    d = documents(spark, sf_dir).where("published is not null").select("id", "published")
    inside = (F.col("published") <= as_of()) & (F.col("published") >= F.date_sub(as_of(), F.col("days") - 1))
    return d.join(F.broadcast(days), inside).groupBy("days").agg(F.count("*").alias("n"), F.min("published").alias("oldest"))


def synthesis_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir).where("use_policy <> 'ARCHIVE_ONLY'").select(F.col("code").alias("source_code"))
    return facts(spark, sf_dir).where("not sample and pos % 19 <> 18").join(s, "source_code").select("code", "doc_id", "fact_type")


def news_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis_facts(spark, sf_dir).join(documents(spark, sf_dir).where("full_text").select(F.col("id").alias("doc_id")), "doc_id", "left_semi").groupBy("fact_type").agg(F.count("*").alias("n"))


def audited_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by a list of codes, those that are no longer active too."""
    asked = facts(spark, sf_dir).where("pos % 19 >= 17").select("code").distinct()
    return facts(spark, sf_dir).join(asked, "code", "left_semi").select("code", (F.col("pos") % 19 != 18).alias("active"))


def facts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = classifications(spark, sf_dir).where(F.array_contains("labels", "SALES_DATA")).select("doc_id")
    return facts(spark, sf_dir).join(asked, "doc_id", "left_semi").select("code", "doc_id")


def version_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one pipeline version whose source may be used."""
    e = facts(spark, sf_dir).select("code", "source_code", F.when(F.col("pos") % 6 == 5, "v1").otherwise("v2").alias("version"))
    ok = sources(spark, sf_dir).where("use_policy = 'DECISION_ELIGIBLE'").select(F.col("code").alias("source_code"))
    return e.where("version = 'v2'").join(ok, "source_code", "left_semi").select("code")


def planner_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = sources(spark, sf_dir).where("use_policy <> 'ARCHIVE_ONLY'").select(F.col("code").alias("source_code"))
    kept = documents(spark, sf_dir).where("not sample and parse_status = 'OK' and full_text and trim(text) <> ''").join(ok, "source_code", "left_semi")
    return kept.select("id")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a document handed in, by the first rule that it breaks."""
    d = documents(spark, sf_dir).withColumn("link", F.when(F.col("id") % 7 == 3, F.concat(F.lit("http://x/"), "id")).when(F.col("id") % 7 == 4, F.concat(F.lit("urn:manual-upload:"), "id")).otherwise(F.col("url")))
    size = F.length(F.trim("text"))
    problem = (
        F.when((F.trim("title") == "") | (F.length(F.trim("title")) > 300), "TITLE").when(~F.col("link").startswith("urn:manual-upload:") & ~F.col("link").startswith("https://"), "ADDRESS")
        .when(F.col("published") > F.date_add(as_of(), 1), "FUTURE").when(~F.lower(F.trim("lang")).isin("en", "vi", "zh", "ko", "ja"), "LANGUAGE").when(size < 600, "SHORT").when(size > 250_000, "LONG").otherwise("ACCEPTED")
    )
    return d.groupBy(problem.alias("problem")).agg(F.count("*").alias("n"))


def valid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and names of sources, normalised and checked."""
    s = sources(spark, sf_dir).withColumn("given", F.concat(F.lit(" "), F.when(F.col("n") % 4 == 0, F.concat("code", F.lit("-x"))).when(F.col("n") % 4 == 1, F.substring("code", 1, 2)).otherwise(F.col("code"))))
    code = F.upper(F.trim("given"))
    return s.select("code", code.alias("normal"), code.rlike("^[A-Z][A-Z0-9_]{2,39}$").alias("valid"))


def safe_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("entity_status", rules.attribution_safe().alias("safe")).agg(F.count("*").alias("n"))


def display_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in the last 30 days by the day that is shown: of the event, else of publication."""
    shown = F.coalesce("occurred", "published")
    return facts(spark, sf_dir).where(rules.within(shown, "2026-07-08", AS_OF)).groupBy(shown.alias("day")).agg(F.count("*").alias("n"))


def hot_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).where((F.col("tier") >= "T3") & F.col("review_status").isin(*APPROVED)).select("claim_id", "tier")


def latest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per latest verdict: which claims may be tried again, published, or are not contradicted."""
    v = latest(verifications(spark, sf_dir), ["claim_id"], LATEST, ["verdict"])
    j = claims(spark, sf_dir).join(v, "claim_id", "left")
    return j.groupBy("review_status").agg(
        F.count_if(F.col("verdict") == "VERIFIER_ERROR").alias("retryable"), F.count_if((F.col("verdict") == "ENTAILED") & (F.col("gate_status") == "PASS")).alias("publishable"),
        F.count_if(F.coalesce("verdict", F.lit("")) != "CONTRADICTED").alias("not_contradicted"),
    )


def life_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed items about life insurance; a plain non-life item is left out."""
    said = ("Bảo hiểm nhân thọ tăng trưởng", "Bảo hiểm phi nhân thọ giảm", "Insurtech for non-life", "Weather", "Thị trường bảo hiểm quý 2", "P&C premiums")
    t = rules.folded(F.element_at(F.array(*map(F.lit, said)), (F.col("id") % len(said) + 1).cast("int")))
    life = rules.any_contains(t, ("bao hiem nhan tho", "life insurance", "insurtech", "bancassurance")) & ~(t.contains("non-life insurance") & ~t.contains("insurtech"))
    other = rules.any_contains(t, ("phi nhan tho", "non-life", "p&c"))
    wide = rules.any_contains(t, ("thi truong bao hiem", "doanh nghiep bao hiem"))
    return documents(spark, sf_dir).select("id", F.when(other & ~life, False).otherwise(life | wide).alias("relevant"))


def fresh_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents fresh enough for a narrative: published in the last 365 days, not in the future."""
    return documents(spark, sf_dir).where((F.col("published") <= as_of()) & (F.col("published") > F.date_sub(as_of(), 365))).select("id", rules.age_days(F.col("published"), AS_OF).alias("age"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each chapter: a market and a set of fact types."""
    dim = spark.createDataFrame([("VN_PRODUCTS", "VN", ["PRODUCT_LAUNCH", "METRIC"]), ("VN_RULES", "VN", ["REGULATION"]), ("ABROAD", "SG", ["PRODUCT_LAUNCH", "REGULATION", "METRIC"])], "chapter string, market string, types array<string>")
    s = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "market")
    j = facts(spark, sf_dir).join(s, "source_code").join(F.broadcast(dim), "market").where(F.array_contains("types", F.col("fact_type")))
    return j.groupBy("chapter").agg(F.count("*").alias("n"))


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose last runs failed, best authority first."""
    g = documents(spark, sf_dir).groupBy("source_code").agg(F.count_if(F.col("parse_status") != "OK").alias("failed"), F.count("*").alias("n"))
    s = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "authority_score")
    return g.where("failed > 0").join(s, "source_code").select("source_code", "authority_score", "failed", "n")


def event_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as the report shows them; without a cluster the counts are one and the key is the event's."""
    f = facts(spark, sf_dir)
    clusters = f.where("company is not null").groupBy("company", "fact_type").agg(F.count("*").alias("n"), F.count_distinct("source_code").alias("n_sources"))
    j = f.join(clusters, ["company", "fact_type"], "left")
    return j.select("code", F.coalesce(F.concat_ws("|", F.col("company"), F.when(F.col("company").isNotNull(), F.col("fact_type"))), F.lit("")).alias("key"), F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("n_sources", F.lit(1)).alias("n_sources"))


def claims_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with document and source; a claim without a document stays."""
    d = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "source_code")
    return claims(spark, sf_dir).join(d, "doc_id", "left").groupBy(F.coalesce("source_code", F.lit("NONE")).alias("source_code")).agg(F.count("*").alias("n"))


def events_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with document, source and, where there is one, the group of their KPI."""
    d = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "lang")
    s = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "authority")
    f = facts(spark, sf_dir)
    k = f.where("kpi_label is not null").groupBy("kpi_label").agg(F.count_distinct("doc_id").alias("kpi_docs"))
    return f.join(d, "doc_id").join(s, "source_code").join(k, "kpi_label", "left").select("code", "lang", "authority", F.coalesce("kpi_docs", F.lit(0)).alias("kpi_docs"))


def by_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a department and a routing state."""
    c = classifications(spark, sf_dir).where("status = 'CONFIRMED'").select("doc_id", F.explode("labels").alias("category"))
    d = c.join(F.broadcast(routing(spark)), "category").groupBy("doc_id").agg(F.array_sort(F.collect_set("department")).alias("departments"))
    return d.where(F.array_contains("departments", "SALES")).select("doc_id", F.array_join("departments", ",").alias("departments"))


def first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with the label of their document's first classification."""
    attempts = classifications(spark, sf_dir).select("doc_id", F.posexplode("labels").alias("attempt", "label"))
    one = first(attempts, ["doc_id"], ["attempt"], ["label"])
    return facts(spark, sf_dir).join(one, "doc_id").groupBy("label").agg(F.count("*").alias("n"))


def without_sample_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = documents(spark, sf_dir).where("sample").select(F.col("id").alias("doc_id"))
    v = verifications(spark, sf_dir).join(claims(spark, sf_dir).join(gone, "doc_id", "left_semi").select("claim_id"), "claim_id", "left_anti")
    return v.groupBy("verdict").agg(F.count("*").alias("n"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document has facts, claims, and a twin of its text."""
    d = documents(spark, sf_dir).select("id", "content_hash")
    f = facts(spark, sf_dir).select(F.col("doc_id").alias("id")).distinct().withColumn("has_facts", F.lit(True))
    c = claims(spark, sf_dir).select(F.col("doc_id").alias("id")).distinct().withColumn("has_claims", F.lit(True))
    twins = d.groupBy("content_hash").agg((F.count("*") > 1).alias("has_twin"))
    yes = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    return d.join(twins, "content_hash").join(f, "id", "left").join(c, "id", "left").select("id", yes("has_facts"), yes("has_claims"), "has_twin")


def known_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose extraction under the present signature is stored already."""
    sign = lambda p: F.sha2(F.concat_ws("\n", F.lit(p), "content_hash"), 256)
    d = documents(spark, sf_dir).select("id", "content_hash")
    stored = d.select("id", F.when(F.col("id") % 3 == 0, sign("p-1")).otherwise(sign("p-2")).alias("signature"))
    return d.select("id", sign("p-2").alias("signature")).join(stored, ["id", "signature"], "left_semi").select("id")


def horizon_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a company that expire within 30 days after another of its facts took effect."""
    f = facts(spark, sf_dir)
    e = f.where("expiry is not null").select("doc_id", F.col("code").alias("expiring"), "expiry")
    a = f.where("effective is not null").select("doc_id", F.col("code").alias("effective_code"), "effective")
    return e.join(a, "doc_id").where(F.col("expiry").between(F.col("effective"), F.date_add("effective", 30))).groupBy("expiring").agg(F.count("*").alias("n"))


def intake_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of a document handed in: by host, else by publisher, else a new one."""
    d = documents(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, F.lit("nowhere.example")).otherwise(F.concat("source_code", F.lit(".example"))).alias("host"), F.when(F.col("id") % 2 == 0, F.upper("source_code")).alias("publisher"))
    s = sources(spark, sf_dir)
    hosts = s.select(F.concat("code", F.lit(".example")).alias("host"), F.col("code").alias("by_host"))
    names = s.select(F.upper("code").alias("publisher"), F.col("code").alias("by_name"))
    return d.join(hosts, "host", "left").join(names, "publisher", "left").select("id", F.coalesce("by_host", "by_name", F.concat(F.lit("NEW:"), "host")).alias("source_code"))


def retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions after a new one of a tier was activated: exactly the newest stays current."""
    e = claims(spark, sf_dir).select("tier", "claim_id", "created")
    newest = e.groupBy("tier").agg(F.max(F.struct("created", "claim_id")).alias("x")).select("tier", F.col("x.claim_id").alias("newest"))
    return e.join(F.broadcast(newest), "tier").groupBy("tier", (F.col("claim_id") == F.col("newest")).alias("current")).agg(F.count("*").alias("n"))


def activated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest successful run of a document that has facts; an empty run activates nothing."""
    runs = item_log(spark, sf_dir).where("status = 'OK'").select("doc_id", "item_id", "created", F.pmod(F.col("item_id"), F.lit(4)).alias("n_facts"))
    return latest(runs.where("n_facts > 0"), ["doc_id"], ["created", "item_id"], ["item_id", "n_facts"]).select("doc_id", "item_id", "n_facts")


def activation_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir).select("claim_id", "gate_status", F.floor(F.col("claim_id") % 4).alias("sentences"))
    return c.groupBy(((F.col("gate_status") == "PASS") & (F.col("sentences") >= 1)).alias("activate")).agg(F.count("*").alias("n"))


def edition_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    signature = F.sha2(F.concat_ws("\n", F.lit("contract-2"), F.lit("model-a"), F.lit("writer"), F.lit("prompt-1")), 256)
    return documents(spark, sf_dir).select("id", signature.alias("signature"), F.sha2("text", 256).alias("input_hash"))


def value_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch added to each company's counts, never below zero."""
    f = facts(spark, sf_dir).where("company is not null")
    g = f.groupBy("company").agg(F.count_if(F.col("pos") < 6).alias("before"), F.count_if(F.col("pos") % 2 == 0).alias("after"))
    return g.select("company", F.greatest(F.col("after") - F.col("before"), F.lit(0)).alias("added"))


def reposted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repost of each language's last readable document by a lesser source, an hour earlier."""
    d = documents(spark, sf_dir).where("parse_status = 'OK'")
    last = latest(d, ["lang"], ["id"], ["id", "url", "fetched_at", "content_hash"])
    return last.select("lang", F.concat("url", F.lit("#repost")).alias("url"), F.lit("OTHER_PUBLISHER").alias("authority"), (F.col("fetched_at") - F.expr("interval 1 hour")).alias("fetched_at"), "content_hash")


def forced_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay cache after the replies of failed claims were dropped, so that they are asked for again."""
    again = claims(spark, sf_dir).where("gate_status <> 'PASS'").select("claim_id")
    return verifications(spark, sf_dir).join(again, "claim_id", "left_anti").groupBy("verdict").agg(F.count("*").alias("kept"))


def checkpoint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the tables, a row per measure."""
    def row(df: DataFrame, name: str, **counts):
        one = df.agg(*(F.count_if(F.expr(c)).alias(k) for k, c in counts.items()))
        return one.select(F.explode(F.array(*(F.struct(F.lit(f"{name}.{k}").alias("measure"), F.col(k).alias("n")) for k in counts))).alias("r")).select("r.*")

    parts = [
        row(documents(spark, sf_dir), "documents", all="true", full_text="full_text", unread="parse_status <> 'OK'", undated="published is null", sample="sample"),
        row(classifications(spark, sf_dir), "classifications", all="true", confirmed="status = 'CONFIRMED'", review="status = 'NO_LABEL_REVIEW'", out="status = 'OUT_OF_SCOPE'"),
        row(facts(spark, sf_dir), "facts", all="true", highlights="highlight", companies="company is not null", metrics="fact_type = 'METRIC'", expiring="expiry is not null"),
        row(claims(spark, sf_dir), "claims", all="true", passed="gate_status = 'PASS'", pending="review_status = 'PENDING_REVIEW'", superseded="superseded"),
        row(verifications(spark, sf_dir), "verifications", all="true", entailed="verdict = 'ENTAILED'", errors="verdict = 'VERIFIER_ERROR'"),
    ]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a reprocessing may start: five blockers, two warnings, two notes."""
    d = documents(spark, sf_dir).agg(F.count_if(~F.col("full_text")).alias("title_only"), F.count_if(F.col("full_text") & (F.col("chars") < 600)).alias("short"), F.count_if(F.col("parse_status") != "OK").alias("unread"), F.count("*").alias("docs"), F.count_if(~F.col("full_text") | (F.col("chars") < 600) | (F.col("parse_status") != "OK")).alias("incomplete"))
    c = claims(spark, sf_dir).agg(F.count_if(F.col("review_status") == "PENDING_REVIEW").alias("pending"))
    f = facts(spark, sf_dir).agg(F.count("*").alias("facts"))
    settings = (("PIPELINE_IDLE", True), ("BACKUP_CONFIRMED", True), ("CLASSIFIER_CONFIGURED", True), ("WRITER_CONFIGURED", True), ("VERIFIER_CONFIGURED", False))
    check = lambda name, severity, passed, detail: F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), passed.alias("passed"), detail.alias("detail"))
    checks = [check(n, "BLOCKER", F.lit(ok), F.lit("")) for n, ok in settings] + [
        check("CONTENT_BACKFILL", "WARNING", F.col("incomplete") == 0, F.concat_ws("/", "title_only", "short", "unread")), check("PENDING_REVIEW", "WARNING", F.col("pending") == 0, F.col("pending").cast("string")),
        check("CORPUS_COUNTS", "INFO", F.lit(True), F.concat_ws("/", "docs", "facts")),
    ]
    return d.join(c).join(f).select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(~F.col("full_text")).alias("title_only"), F.count_if(F.col("full_text") & (F.col("chars") < 600)).alias("short"), F.count_if(F.col("parse_status") != "OK").alias("unread"))


def subject_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket and subject with two findings or more get a page of their own."""
    return facts(spark, sf_dir).where("trim(company) <> ''").groupBy("fact_type", "company").agg(F.count("*").alias("n")).where("n >= 2")


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "primary_source")
    return facts(spark, sf_dir).join(s, "source_code").groupBy("fact_type").agg(F.count_distinct("source_code").alias("sources"), F.count_distinct(F.when(F.col("primary_source"), F.col("source_code"))).alias("primary_sources"), F.count_distinct("kpi_label").alias("topics"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a company's facts make together: independent documents and sources, scores, first three lines."""
    s = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "primary_source", "authority_score")
    f = facts(spark, sf_dir).where("company is not null").join(s, "source_code")
    three = f.groupBy("company").agg(F.min_by(F.sha2("span", 256), "code").alias("first_line"))
    g = f.groupBy("company").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("source_code").alias("sources"), F.bool_or("primary_source").alias("official"), F.round(F.avg("authority_score")).cast("long").alias("score"), F.bool_and("highlight").alias("all_highlights"))
    return g.join(three, "company")


def first_per_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))


def ranked_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a document numbered in the order of highlight and code."""
    order = F.array_sort(F.collect_list(F.struct((~F.col("highlight")).alias("later"), "code")))
    g = facts(spark, sf_dir).groupBy("doc_id").agg(order.alias("x"))
    return g.select("doc_id", F.posexplode("x").alias("rank", "r")).select("doc_id", (F.col("rank") + 1).cast("long").alias("rank"), "r.code")


def key_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three highlights of a document, else its first three facts."""
    f = facts(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("highlight"), F.col("code")))).alias("h"), F.array_sort(F.collect_list("code")).alias("c"))
    return f.select("doc_id", F.array_join(F.slice(F.when(F.size("h") > 0, F.col("h")).otherwise(F.col("c")), 1, 3), ",").alias("codes"))


def ordered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten first documents: newest first with undated ones last, then source and id."""
    d = documents(spark, sf_dir).select("id", "source_code", "published")
    return d.orderBy(F.desc_nulls_last("published"), "source_code", "id").limit(10)


def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = facts(spark, sf_dir).groupBy("company", "fact_type").agg(F.count("*").alias("n"), F.max("published").alias("newest"))
    return g.orderBy(F.desc("n"), F.desc_nulls_last("newest"), F.asc_nulls_last("company"), "fact_type").limit(12)


def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "authority_score")
    f = facts(spark, sf_dir).join(s, "source_code").select("code", "authority_score", "fact_type", F.coalesce("company", F.lit("")).alias("subject"))
    return f.orderBy(F.desc("authority_score"), "fact_type", "subject", "code").limit(15)


def log_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_log(spark, sf_dir).orderBy(F.desc("created"), F.desc("item_id")).limit(20).select("item_id", "stage", "status")


def tier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).where(F.col("tier") >= "T2").groupBy("tier").agg(F.count("*").alias("n"), F.min("claim_id").alias("first_id"))


def clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of a size between 1 and 25, whatever was asked for."""
    asked = F.col("id") % 60 - 10
    return documents(spark, sf_dir).select("id", F.greatest(F.lit(1), F.least(asked, F.lit(25))).alias("size"))


def due_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims to verify: those pending, and those whose last check failed, each once."""
    c = claims(spark, sf_dir)
    v = latest(verifications(spark, sf_dir), ["claim_id"], LATEST, ["verdict"])
    pending = c.where("review_status = 'PENDING_REVIEW'").select("claim_id", F.lit("PENDING").alias("why"))
    again = v.where("verdict = 'VERIFIER_ERROR'").select("claim_id", F.lit("RETRY").alias("why"))
    return union_by_precedence([pending, again], ["claim_id"])


def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference, union and intersection of a source's labels with all labels and with its neighbours'."""
    d = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "lang")
    g = classifications(spark, sf_dir).join(d, "doc_id").groupBy("lang").agg(F.array_distinct(F.flatten(F.collect_set("labels"))).alias("have"), F.array_distinct(F.flatten(F.collect_set(F.when(F.col("status") == "CONFIRMED", F.col("labels"))))).alias("sure"))
    every = F.array(*map(F.lit, CATEGORIES))
    show = lambda c: F.array_join(F.array_sort(c), ",")
    return g.select("lang", show(F.array_except(every, "have")).alias("missing"), show(F.array_union("have", "sure")).alias("either"), show(F.array_intersect("have", "sure")).alias("both"), (~F.arrays_overlap("sure", F.array(F.lit("SALES_DATA")))).alias("disjoint"))


def citation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited codes against resolved ones: what is unresolved, whether all lie within, whether the sets are equal."""
    i = F.col("claim_id")
    cited, known = F.array(i % 5, i % 7, i % 5), F.array(i % 5, i % 3)
    d = claims(spark, sf_dir).select("claim_id", F.array_distinct(cited).alias("c"), F.array_distinct(known).alias("k"))
    return d.select("claim_id", F.size(F.array_except("c", "k")).alias("unresolved"), ((F.size("c") > 0) & (F.size(F.array_except("c", "k")) == 0)).alias("within"), (F.array_sort("c") == F.array_sort("k")).alias("equal"), F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("in_order"))


def missing_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of a fixed list that no fact of a company falls into."""
    dim = spark.createDataFrame([(b,) for b in ("PRODUCT_LAUNCH", "REGULATION", "METRIC", "CORPORATE_ACTION", "OTHER", "PRICING")], "fact_type string")
    have = facts(spark, sf_dir).where("company is not null").select("company", "fact_type").distinct()
    return have.select("company").distinct().join(F.broadcast(dim)).join(have, ["company", "fact_type"], "left_anti")


def late_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far back the pairing window of 72 hours reaches for documents that come late."""
    at = F.coalesce("published_at", "fetched_at")
    return documents(spark, sf_dir).select("id", F.floor(F.unix_timestamp(at) / 259_200).alias("band"), F.floor((F.unix_timestamp(at) - 259_200) / 259_200).alias("reaches"))


def monthly_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.coalesce("occurred", "effective", "published")
    return facts(spark, sf_dir).groupBy(F.coalesce(F.date_format(F.trunc(day, "month"), "yyyy-MM"), F.lit("UNDATED")).alias("month")).agg(F.count("*").alias("n"))


def held_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed items that wait until the version changes: the last attempt is of the present version and failed."""
    a = item_log(spark, sf_dir).select("doc_id", "item_id", "created", "status", F.when(F.col("item_id") % 3 == 0, "v1").otherwise("v2").alias("version"))
    last = latest(a, ["doc_id"], ["created", "item_id"], ["status", "version"])
    state = F.when(F.col("status") == "OK", "DONE").when(F.col("version") == "v2", "HELD").otherwise("DUE")
    return last.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do next per language: another batch, an audit, or nothing, from what the last batch added."""
    f = facts(spark, sf_dir).join(documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "lang"), "doc_id")
    g = f.groupBy("lang").agg(F.count_distinct(F.when(F.col("pos") < 6, F.col("company"))).alias("before"), F.count_distinct("company").alias("after"), F.count_distinct("doc_id").alias("docs"))
    return g.select("lang", "before", "after", F.when(F.col("after") > F.col("before"), "NEXT_BATCH").when(F.col("docs") >= 20, "AUDIT").otherwise("READY").alias("decision"))


def recovered_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that was queued or running when the system stopped counts as failed; the rest keeps its state."""
    state = F.when(F.col("status") == "SKIPPED", "RUNNING").when(F.col("status") == "ERROR", "QUEUED").otherwise("DONE")
    q = item_log(spark, sf_dir).select("stage", state.alias("was"))
    return q.groupBy("stage", "was", F.when(F.col("was").isin("RUNNING", "QUEUED"), "FAILED").otherwise(F.col("was")).alias("now")).agg(F.count("*").alias("n"))


def single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that may start: none of the same hour started before them."""
    r = run_log(spark, sf_dir).select("run_id", F.date_trunc("hour", "started").alias("hour"))
    lead = r.groupBy("hour").agg(F.min("run_id").alias("leader"))
    return r.join(lead, "hour").groupBy((F.col("run_id") == F.col("leader")).alias("started")).agg(F.count("*").alias("n"))


def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as cluster keys, in which numbers of every kind stay."""
    d = documents(spark, sf_dir)
    return d.select("id", F.sha2(text.normal_title(F.concat("title", F.lit(" ②")), "N"), 256).alias("key"))


def gate_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gravest of a claim's failures: the one that comes first in the order of the gates."""
    i = F.col("claim_id")
    failed = F.array_compact(F.array(*(F.when(i % p == 0, F.lit(k)) for k, p in enumerate((17, 13, 11, 7, 5, 3)))))
    worst = F.coalesce(F.array_min(failed), F.lit(len(GATES) - 1))
    return claims(spark, sf_dir).groupBy(F.element_at(F.array(*map(F.lit, GATES)), worst + 1).alias("status")).agg(F.count("*").alias("n"))


def literal_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("On 2026-7-"), F.col("pos") % 40, F.lit(", 1/"), F.col("pos") % 14, F.lit("/2026 and 2026年8月"), F.col("pos") % 31 + 1, F.lit("日"))
    return facts(spark, sf_dir).select("code", F.array_join(text.date_literals(said).cast("array<string>"), ",").alias("dates"))


def names_in_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("“Plan "), F.col("pos"), F.lit("” and «An Tâm» or \"x\" and 'this product'"))
    return facts(spark, sf_dir).select("code", F.array_join(text.quoted_names(said), "|").alias("names"))


def generic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.grounding import generic_reference

    said = ("this procedure", "thủ tục này", "An Tâm", "The Policies", "those fees")
    return facts(spark, sf_dir).select("code", generic_reference(F.element_at(F.array(*map(F.lit, said)), F.col("pos") % len(said) + 1)).alias("generic"))


def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: text.word_set(text.normal_title(c))
    d = documents(spark, sf_dir).join(facts(spark, sf_dir).where("pos = 0").select(F.col("doc_id").alias("id"), "span"), "id")
    return d.select("id", F.round(text.jaccard(words(F.col("title")), words(F.col("span"))), 6).alias("overlap"))


def cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", F.length(text.cut_after(F.col("text"), 300)).alias("after"), F.length(text.cut_within(F.col("text"), 300)).alias("within"))


def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", F.sha2("text", 256).alias("plain"), "content_hash")


def dedup_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", F.md5(text.thirds(F.col("text"), 1800, 600, " … ")).alias("excerpt"))


def verdict_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model's answer means; anything unknown is an error of the verifier."""
    said = ("Entailed.", " contradicted ", "NEUTRAL", "maybe", "", "not ENTAILED? no")
    t = F.upper(F.regexp_replace(F.element_at(F.array(*map(F.lit, said)), (F.col("claim_id") % len(said) + 1).cast("int")), r"[^A-Za-z]", ""))
    verdict = F.when(t == "ENTAILED", "ENTAILED").when(t == "CONTRADICTED", "CONTRADICTED").when(t == "NEUTRAL", "NEUTRAL").otherwise("VERIFIER_ERROR")
    return claims(spark, sf_dir).groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as JSON strings and back."""
    j = documents(spark, sf_dir).select("id", "title", F.to_json(F.struct(F.concat("title", F.lit(' "q" \\ \t')).alias("t"))).alias("j"))
    return j.select("id", F.sha2(F.get_json_object("j", "$.t"), 256).alias("back"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda part, *key: F.try_parse_url("url", F.lit(part), *map(F.lit, key))
    return table(spark, sf_dir, "pages").select("page_id", F.lower(p("HOST")).alias("host"), p("QUERY", "page").alias("page"), F.lower(p("HOST")).endswith(".example.com").alias("same_site"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts with one site at most and eight units, a quoted phrase being one."""
    q = F.concat(F.lit('site:a.example "life insurance" '), "title", F.lit(" site:b.example"))
    bare = F.trim(F.regexp_replace(q, r"site:\S+", ""))
    units = F.slice(F.regexp_extract_all(bare, F.lit(r'("[^"]*"|\S+)'), 1), 1, 8)
    return documents(spark, sf_dir).select("id", F.concat_ws(" ", F.array_join(units, " "), F.lit("site:a.example")).alias("query"))


def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for display: one kind of dash, no scaffolding, no space before punctuation."""
    raw = F.concat(F.lit(" year#on#year – "), F.substring("title", 1, 20), F.lit(" , up ; (Pattern: two facts)  end ."))
    t = F.regexp_replace(F.trim(raw), "[‐-―−]", "-")
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N}])#(?=[\p{L}\p{N}])", "-")
    t = F.regexp_replace(t, r"(?iu)\s*;?\s*\(Pattern:\s*two\s*facts\)\s*", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+([,.;:])", "$1"), r"[ \t]{2,}", " "))
    return documents(spark, sf_dir).select("id", t.alias("shown"))


def localised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflow words of English left in Vietnamese prose, in Vietnamese."""
    raw = F.concat(F.lit("Caveat: "), F.substring("title", 1, 10), F.lit(" facts, evidence and gates"))
    t = F.regexp_replace(raw, r"(?iu)^Caveat\s*:\s*", "Giới hạn bằng chứng: ")
    for pattern, word in ((r"(?iu)\bfacts?\b", "dữ kiện"), (r"(?iu)\bevidence\b", "bằng chứng"), (r"(?iu)\bgates?\b", "cổng kiểm định")):
        t = F.regexp_replace(t, pattern, word)
    return documents(spark, sf_dir).select("id", t.alias("shown"))


PLACES = (("VN", "Vietnam"), ("SG", "Singapore"), ("HK", "Hong Kong"), ("TW", "Taiwan"), ("KR", "South Korea"), ("JP", "Japan"), ("CN", "China"), ("GLOBAL", "Global"))


def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in PLACES for x in pair))
    s = sources(spark, sf_dir)
    token = F.regexp_extract(F.concat(F.lit("_"), F.upper("code"), F.element_at(F.array(*map(F.lit, ("_HK", "_JP_X", "", "_KR"))), (F.col("n") % 4 + 1).cast("int")), F.lit("_")), "_(HK|SG|TW|KR|JP|CN)_", 1)
    return s.select("code", F.coalesce(names[F.col("market")], F.when(token != "", names[token]), F.lit("Regional / international")).alias("place"))


def date_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One legacy date as day of occurrence, of effect or of a forecast, by fact type and whether it lies ahead."""
    day = F.coalesce("effective", "occurred")
    known, future = day.isNotNull() & F.col("published").isNotNull(), day > F.col("published")
    rule, metric = F.col("fact_type") == "REGULATION", F.col("fact_type") == "METRIC"
    return facts(spark, sf_dir).select("code", F.when(known & ~future, day).alias("occurred"), F.when(known & future & rule, day).alias("effective"), F.when(known & future & metric, day).alias("forecast"))


def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", F.to_date(F.from_utc_timestamp("fetched_at", ZONE)).alias("day"), rules.age_days(F.col("published"), AS_OF).alias("age"))


def story_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of events and stories from their members' hashes."""
    k = facts(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("code")), "\n").alias("m"))
    return k.select("doc_id", F.concat(F.lit("RC:"), F.substring(F.sha2("m", 256), 1, 20)).alias("story_key"), F.concat(F.lit("ME:"), "doc_id", F.lit(":"), F.substring(F.sha2(F.lit("v2"), 256), 1, 16)).alias("event_key"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a written reply: both languages needed, codes stripped, unknown buckets dropped."""
    one = F.struct(F.col("title").alias("vi"), F.when(F.col("id") % 4 != 0, F.col("title")).alias("en"), F.concat(F.lit(" F-1 , ,F-"), "id").alias("codes"), F.when(F.col("id") % 3 == 0, "PRODUCT").otherwise("GOSSIP").alias("bucket"))
    reply = documents(spark, sf_dir).select("id", F.to_json(F.array(one)).alias("j"), "title")
    s = reply.select("id", F.explode(F.from_json("j", "array<struct<vi:string,en:string,codes:string,bucket:string>>")).alias("s"))
    ok = (F.coalesce(F.trim("s.vi"), F.lit("")) != "") & (F.coalesce(F.trim("s.en"), F.lit("")) != "")
    return s.where(ok).select("id", F.array_join(text.codes(F.col("s.codes")), ",").alias("codes"), F.when(F.col("s.bucket").isin("PRODUCT", "SALES"), F.col("s.bucket")).alias("bucket"))


def numbers_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all numbers of a statement stand in its evidence."""
    said = F.concat(F.lit("up "), F.col("pos") % 4, F.lit("% to 1,200"))
    given = F.concat(F.lit("grew 2% and 3% to 1,200 of "), "pos")
    return facts(spark, sf_dir).select("code", (F.size(F.array_except(text.number_tokens(said), text.number_tokens(given))) == 0).alias("within"))


def routed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a router filled, each kept only where it is allowed or stands in the span."""
    p = F.col("pos")
    bucket, trend = F.element_at(F.array(*map(F.lit, ("METRIC", "RUMOUR", "OTHER"))), p % 3 + 1), F.element_at(F.array(*map(F.lit, ("UP", "DOWN", "SIDEWAYS", "FLAT"))), p % 4 + 1)
    value = F.when(p % 2 == 0, F.substring("span", 5, 6)).otherwise("not there 9")
    return facts(spark, sf_dir).select("code", F.when(bucket.isin("METRIC", "OTHER"), bucket).alias("bucket"), F.when(trend.isin("UP", "DOWN", "FLAT"), trend).alias("trend"), F.contains("span", value).alias("value_kept"))


def temporal_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy(rules.temporal_role().alias("role")).agg(F.count("*").alias("n"))


TOPICS = (("PRODUCT_LAUNCH", "PRODUCT_OFFER"), ("REGULATION", "REGULATORY"), ("METRIC", "FINANCIAL_PERFORMANCE"), ("CORPORATE_ACTION", "CORPORATE_ACTION"))


def fallback_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.create_map(*(F.lit(x) for pair in TOPICS for x in pair))
    topic = F.coalesce(F.when(F.col("kpi_label").isNotNull(), "SALES"), named[F.col("fact_type")], F.lit("OTHER"))
    return facts(spark, sf_dir).groupBy(topic.alias("topic")).agg(F.count("*").alias("n"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir).select("code", F.concat(F.lit("life-insurance_"), "code").alias("slug"))
    return s.select("code", text.slug_label(F.col("slug")).alias("label"))


def split_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.concat(F.lit(" F-1, ,F-"), "doc_id", F.lit(",  "))
    return classifications(spark, sf_dir).select("doc_id", F.array_join(text.codes(listed), "|").alias("codes"))


def broken_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose value lies outside of a closed domain: what a check constraint would reject."""
    c = classifications(spark, sf_dir).select(F.explode("labels").alias("label"))
    bad = c.select(F.when(F.col("label") == "SALES_DATA", "SALES-DATA").otherwise(F.col("label")).alias("label")).where(~F.col("label").isin(*CATEGORIES))
    return bad.groupBy("label").agg(F.count("*").alias("n"))


def filled_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources after their unknown markets were filled in from their codes; what is known stays."""
    guess = F.when(F.col("n") % 3 == 0, "VN").otherwise("UNKNOWN")
    return sources(spark, sf_dir).select("code", F.coalesce("market", guess).alias("market"), F.col("market").isNull().alias("inferred"))


def upserted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources after an update: listed ones take the new authority, new ones are added, others stay."""
    old = sources(spark, sf_dir).select("code", "authority")
    new = old.where("code like 'src1%'").select("code", F.lit("INDUSTRY_BODY").alias("authority")).unionByName(spark.createDataFrame([("added", "UNKNOWN")], "code string, authority string"))
    return union_by_precedence([new, old], ["code"])


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("n") % 3 == 0, F.concat(F.lit("own "), "code")).when(F.col("n") % 3 == 1, "  ")
    return sources(spark, sf_dir).select("code", F.coalesce(F.nullif(F.trim(own), F.lit("")), F.lit("default prompt")).alias("body"))


def broken_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that should be unique and are not, with how often they stand."""
    return documents(spark, sf_dir).groupBy("content_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two copies stands: better authority, else the newer of two dated ones, else the first, flagged."""
    s = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "authority_score")
    d = documents(spark, sf_dir).select("id", "source_code", "content_hash", "published_at").join(s, "source_code")
    firsts = d.groupBy("content_hash").agg(F.min_by(F.struct("id", "authority_score", "published_at"), "id").alias("f"), F.count("*").alias("n")).where("n > 1").select("content_hash", "f")
    j = d.join(firsts, "content_hash").where("id <> f.id")
    newer = F.col("published_at").isNotNull() & F.col("f.published_at").isNotNull() & (F.col("published_at") != F.col("f.published_at"))
    win = F.when(F.col("authority_score") > F.col("f.authority_score"), F.col("id")).when(F.col("authority_score") < F.col("f.authority_score"), F.col("f.id")).when(newer & (F.col("published_at") > F.col("f.published_at")), F.col("id")).otherwise(F.col("f.id"))
    return j.select(F.col("f.id").alias("a"), F.col("id").alias("b"), win.alias("winner"), ((F.col("authority_score") == F.col("f.authority_score")) & ~newer).alias("flagged"))


def narrative_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that may feed a narrative: passed, not superseded, approved, not contradicted."""
    v = latest(verifications(spark, sf_dir), ["claim_id"], LATEST, ["verdict"])
    return claims(spark, sf_dir).where((F.col("gate_status") == "PASS") & ~F.col("superseded") & F.col("review_status").isin(*APPROVED)).join(v.where("verdict <> 'CONTRADICTED'"), "claim_id").select("claim_id", "verdict")


def unique_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that a claim cites, well formed, allowed and once each, in their order."""
    i = F.col("claim_id")
    cited = F.array(F.concat(F.lit("F-"), i % 4), F.lit("X-1"), F.concat(F.lit("F-"), i % 3), F.concat(F.lit("F-"), i % 4))
    safe = F.filter(F.array_distinct(cited), lambda c: c.rlike(r"^F-\d+$") & c.isin("F-0", "F-1", "F-2"))
    return claims(spark, sf_dir).select("claim_id", F.array_join(safe, ",").alias("codes"))


def provider_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether writer and verifier are real models of different families."""
    models = ("stub", "claude-x", "gpt-y", "deepseek-z")
    pick = lambda n: F.element_at(F.array(*map(F.lit, models)), (n % len(models) + 1).cast("int"))
    c = claims(spark, sf_dir).select(pick(F.col("claim_id")).alias("writer"), pick(F.floor(F.col("claim_id") / 5)).alias("verifier"))
    head = lambda m: F.substring_index(m, "-", 1)
    ok = ~F.col("writer").contains("stub") & ~F.col("verifier").contains("stub") & (head("writer") != head("verifier"))
    return c.groupBy("writer", "verifier", ok.alias("allowed")).agg(F.count("*").alias("n"))


def golden_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sums of factors with their decision."""
    i = F.col("claim_id")
    factors = F.array(i % 11 * 10, i % 7 * 15, i % 5 * 25)
    weights = F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25))
    total = F.aggregate(F.zip_with(factors, weights, lambda f, w: f * w), F.lit(0.0), lambda a, b: a + b)
    s = claims(spark, sf_dir).select("claim_id", total.alias("score"))
    return s.select("claim_id", "score", F.when(F.col("score") >= 75, "PUBLISH").when(F.col("score") >= 55, "REVIEW").when(F.col("score") >= 35, "WATCH").otherwise("DROP").alias("decision"))


def page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each tier's report: those with content only, numbered through."""
    c = claims(spark, sf_dir).groupBy("tier").agg(F.count_if(F.col("review_status").isin(*APPROVED)).alias("findings"), F.count_if(F.col("gate_status") != "PASS").alias("gaps"), F.count_if(F.col("superseded")).alias("old"))
    pages = F.array_compact(F.array(F.lit("COVER"), F.when(F.col("findings") > 0, "FINDINGS"), F.when(F.col("old") > 1_000_000, "HISTORY"), F.when(F.col("gaps") > 0, "GAPS"), F.lit("SOURCES")))
    return c.select("tier", F.posexplode(pages).alias("k", "page")).select("tier", (F.col("k") + 1).cast("long").alias("number"), "page")


def brief_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a source's brief is written: with decisions, as a watch, or not at all."""
    s = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "primary_source")
    g = facts(spark, sf_dir).join(s, "source_code").groupBy("source_code").agg(F.count_if("highlight").alias("highlights"), F.bool_or("primary_source").alias("official"), F.count("*").alias("n"))
    return g.select("source_code", F.when((F.col("highlights") >= 3) & F.col("official"), "DECISION").when(F.col("highlights") >= 1, "WATCH").otherwise("NONE").alias("mode"))


def news_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic of a document's news by the first of its labels that has one, and its market scope."""
    has = lambda *names: F.arrays_overlap("labels", F.array(*map(F.lit, names)))
    topic = F.when(has("PRODUCT_REGULATION", "INDUSTRY_REGULATION"), "REGULATION").when(has("PRODUCT_LAUNCH", "FEE_BENEFIT_COMMISSION_CHANGE"), "PRODUCT").when(has("DISTRIBUTION_CHANNEL"), "DISTRIBUTION").when(has("SALES_DATA", "COMPANY_FINANCIAL_PERFORMANCE"), "PERFORMANCE").otherwise("OTHER")
    s = sources(spark, sf_dir).select(F.col("code").alias("source_code"), F.when(F.col("market") == "VN", "VIETNAM").when(F.col("market").isNull(), "UNKNOWN").otherwise("INTERNATIONAL").alias("scope"))
    d = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "source_code").join(s, "source_code")
    return classifications(spark, sf_dir).join(d, "doc_id").groupBy(topic.alias("topic"), "scope").agg(F.count("*").alias("n"))


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The theme of an insight's event, or none where foreign rules and corporate news are left out."""
    from ..bindings import insights

    regional = F.col("insight_id") % 2 == 0
    event = F.col("event_type")
    theme = (
        F.when(regional & (F.col("insight_id") % 9 == 0), "REGIONAL_TRANSFER").when(event == "REGULATORY_CHANGE", F.when(regional, None).otherwise(F.lit("VN_REGULATORY_CHANGE")))
        .when(event.isin("PRODUCT_LAUNCH"), F.when(regional, "REGIONAL_TRANSFER").otherwise("VN_PRODUCT_OFFER")).when(event == "DISTRIBUTION_CHANGE", F.when(regional, "REGIONAL_TRANSFER").otherwise("DISTRIBUTION_INNOVATION"))
        .when(event == "CORPORATE_NEWS", None).otherwise("MARKET_PATTERN")
    )
    return insights(spark, sf_dir).groupBy(F.coalesce(theme, F.lit("NONE")).alias("theme")).agg(F.count("*").alias("n"))


def owned_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions that name their owner, a horizon and a criterion."""
    said = ("Owner: Product; compare within 60 days; criterion: price", "Owner: Product; compare soon; criterion: price", "Owner: Sales; within 30 days; criterion: x", "owner: product within 45 days by a criterion")
    a = F.lower(F.trim(F.element_at(F.array(*map(F.lit, said)), (F.col("claim_id") % len(said) + 1).cast("int"))))
    ok = a.startswith("owner: product") & a.rlike(r"(?s).*within (30|45|60|90) days.*") & a.contains("criterion")
    return claims(spark, sf_dir).groupBy(ok.alias("complete")).agg(F.count("*").alias("n"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with the authority, place, role and topic that extraction adds."""
    s = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "authority", "market")
    named = F.create_map(*(F.lit(x) for pair in TOPICS for x in pair))
    f = facts(spark, sf_dir).join(s, "source_code")
    return f.select("code", "authority", F.coalesce("market", F.lit("UNKNOWN")).alias("market"), rules.temporal_role().alias("role"), F.coalesce(named[F.col("fact_type")], F.lit("OTHER")).alias("topic"))


def label_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels that the documents of a source have together, and how many more that is than any one has."""
    d = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "source_code")
    g = classifications(spark, sf_dir).join(d, "doc_id").groupBy("source_code").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("u"), F.max(F.size("labels")).alias("most"))
    return g.select("source_code", F.array_join("u", ",").alias("labels"), (F.size("u") - F.col("most")).alias("more"))


def shared_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's labels meet those that a department reads."""
    sales = F.array(*map(F.lit, ("PRODUCT_LAUNCH", "FEE_BENEFIT_COMMISSION_CHANGE", "SALES_DATA", "DISTRIBUTION_CHANNEL")))
    return classifications(spark, sf_dir).select("doc_id", F.size(F.array_intersect("labels", sales)).alias("common"), (~F.arrays_overlap("labels", sales)).alias("disjoint"))


def within_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = F.array(F.concat(F.lit("F-"), F.col("claim_id") % 4), F.concat(F.lit("F-"), F.col("claim_id") % 6))
    allowed = F.array(*(F.lit(f"F-{k}") for k in range(4)))
    return claims(spark, sf_dir).groupBy((F.size(F.array_except(cited, allowed)) == 0).alias("within")).agg(F.count("*").alias("n"))


def closed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies whose fields are exactly those that were asked for."""
    i = F.col("claim_id")
    reply = F.when(i % 3 == 0, '{"what": 1, "why": 2}').when(i % 3 == 1, '{"why": 1, "what": null}').otherwise('{"what": 1, "why": 2, "more": 3}')
    wanted = F.array(F.lit("what"), F.lit("why"))
    return claims(spark, sf_dir).groupBy((F.array_sort(F.json_object_keys(reply)) == wanted).alias("closed")).agg(F.count("*").alias("n"))


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of a user's events, once each in the order in which they came first."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_type"))).alias("x"))
    return g.select("user_id", F.array_join(F.transform("x", lambda r: r["event_type"]), ",").alias("kinds"))


def wide_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import grounding

    said = F.concat(F.lit("on 2 Sept 2026, May "), F.col("pos") % 31 + 1, F.lit("th, 2026 or "), F.col("pos") % 28 + 1, F.lit(".6.2026"))
    return facts(spark, sf_dir).select("code", F.array_join(grounding.wide_dates(said).cast("array<string>"), ",").alias("dates"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.concat_ws("\n", "url", "html"), 256).alias("sha"))


NAMES = {"REGULATOR": "Regulator", "STATUTORY_DISCLOSURE": "Statutory disclosure", "OFFICIAL_COMPANY": "Company", "INDUSTRY_BODY": "Industry body", "ESTABLISHED_MEDIA": "Media"}


def shown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with the words that a report shows for their authority, role and market."""
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    market = F.create_map(*(F.lit(x) for pair in PLACES for x in pair))
    return sources(spark, sf_dir).select("code", F.coalesce(names[F.col("authority")], F.lit("Other")).alias("authority"), F.when(F.col("primary_source"), "Primary").otherwise("Secondary").alias("role"), F.coalesce(market[F.col("market")], F.lit("Global / regional")).alias("market"))


def fact_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).where("published is not null").groupBy(rules.age_days(F.col("published"), AS_OF).alias("age")).agg(F.count("*").alias("n"))


def actionable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by temporal status, and whether an action may follow from them."""
    s = facts(spark, sf_dir).select(rules.temporal_status(AS_OF).alias("status"))
    return s.groupBy("status", (~F.col("status").isin("EXPIRED", "INVALID_DATE_RANGE")).alias("actionable")).agg(F.count("*").alias("n"))


def cited_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's citations: of facts that show the same label the first stays."""
    f = facts(spark, sf_dir).select("source_code", F.concat_ws(" ", "source_code", F.coalesce(F.date_format("published", "yyyy-MM"), F.lit("undated"))).alias("label"), "code")
    return f.groupBy("source_code", "label").agg(F.min("code").alias("code"))


def rebuilt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table of an old shape is dropped and made again: rows of the new shape only."""
    path = scratch(spark, "rebuilt")
    sources(spark, sf_dir).select("code", F.lit(1).alias("tier")).write.parquet(path)
    sources(spark, sf_dir).select("code", "authority").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing rules of an empty table: the fixed ones; a table with rows stays as it is."""
    empty = routing(spark).where("false")
    kept = empty.unionByName(routing(spark)) if empty.isEmpty() else empty
    return kept.select("category", "department")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that a person must look at, beside the whole log of decisions."""
    log = verifications(spark, sf_dir).select("claim_id", F.when(F.col("verdict") == "NEUTRAL", "NEEDS_REVIEW").otherwise(F.col("verdict")).alias("v"))
    return log.groupBy("v").agg(F.count("*").alias("n"), F.count_distinct("claim_id").alias("claims"))


QUERIES = {
    "a02_sources_in_order": sources_in_order, "a03_ingest_summary": ingest_summary, "a07_page_text": page_text, "a24_with_source": with_source, "a26_pasted_list": pasted,
    "b03_failure_rows": failure_rows, "b04_csv_lines": csv_lines, "b09_logged": logged, "b11_cache_writes": cache_writes, "b12_rebuilt_windows": rebuilt, "c02_synthesis_facts": synthesis_facts, "c03_news_candidates": news_candidates,
    "c04_audited_codes": audited_codes, "c05_facts_of": facts_of, "c06_version_events": version_events, "c12_planner_content": planner_content, "c16_submissions": submissions, "c17_valid_codes": valid_codes, "c18_safe_facts": safe_facts,
    "c19_display_dates": display_dates, "c20_hot_claims": hot_claims, "c21_latest_states": latest_states, "c22_life_feed": life_feed, "c25_fresh_inputs": fresh_inputs, "c26_chapters": chapters, "c27_source_health": source_health,
    "c28_event_views": event_views, "c30_review_queue": review_queue, "d02_claims_with_sources": claims_with_sources, "d03_events_in_full": events_in_full, "d04_by_department": by_department, "d07_first_labels": first_labels,
    "d12_without_sample_claims": without_sample_claims, "d13_probes": probes, "d15_known_versions": known_versions, "d21_horizon_pairs": horizon_pairs, "d25_intake_sources": intake_sources, "e02_retired": retired, "e03_activated": activated,
    "e05_activation_rule": activation_rule, "e06_edition_keys": edition_keys, "e16_value_ledger": value_ledger, "e18_reposted": reposted, "e19_forced_retry": forced_retry, "f11_checkpoint_counts": checkpoint_counts, "m24_preflight": preflight,
    "f12_inventory": inventory, "f14_subject_pages": subject_pages, "f18_distinct_counts": distinct_counts, "f20_drafts": drafts, "g03_first_per_url": first_per_url, "g16_ranked_insights": ranked_insights, "g18_key_findings": key_findings,
    "h01_ordered_documents": ordered_documents, "h03_cluster_order": cluster_order, "h04_finding_order": finding_order, "h05_log_order": log_order, "h06_tier_order": tier_order, "h08_clamped": clamped, "i02_due_claims": due_claims,
    "i03_label_sets": label_sets, "i06_citation_sets": citation_sets, "i09_missing_buckets": missing_buckets, "j02_late_pairs": late_pairs, "j04_monthly_keys": monthly_keys, "j08_held_attempts": held_attempts, "j09_saturation": saturation,
    "j10_recovered_queue": recovered_queue, "j11_single_flight": single_flight, "k02_entity_keys": entity_keys, "k04_gate_statuses": gate_statuses, "k06_literal_dates": literal_dates, "k09_names_in_quotes": names_in_quotes,
    "k10_generic_names": generic_names, "k11_span_overlap": span_overlap, "k14_cut_texts": cut_texts, "k16_text_hashes": text_hashes, "k19_dedup_excerpts": dedup_excerpts, "k26_verdict_words": verdict_words, "k28_json_strings": json_strings,
    "k32_url_parts": url_parts, "k33_search_queries": search_queries, "k35_display_texts": display_texts, "k36_localised": localised, "k38_place_names": place_names, "k39_date_dimensions": date_dimensions, "k40_local_days": local_days,
    "k45_story_keys": story_keys, "k48_slugs": slugs, "k49_split_codes": split_codes, "k50_sentences": sentences, "k51_numbers_within": numbers_within, "k54_routed_fields": routed_fields, "k55_temporal_roles": temporal_roles,
    "k56_fallback_topics": fallback_topics, "l01_broken_domains": broken_domains, "l04_filled_metadata": filled_metadata, "l05_upserted_sources": upserted_sources, "l06_prompts": prompts, "l07_broken_keys": broken_keys, "m02_winners": winners,
    "m15_narrative_inputs": narrative_inputs, "m19_owned_actions": owned_actions, "m21_themes": themes, "m22_news_topics": news_topics, "m26_enriched": enriched, "m28_brief_modes": brief_modes, "m29_page_plan": page_plan,
    "i04_label_unions": label_unions, "i05_shared_labels": shared_labels, "i07_within_allowed": within_allowed, "i08_closed_fields": closed_fields, "i10_first_seen": first_seen, "k07_wide_dates": wide_dates, "k15_hashes": hashes,
    "k37_shown_labels": shown_labels, "k41_fact_ages": fact_ages, "k44_actionable": actionable, "m34_cited_once": cited_once, "l02_rebuilt_table": rebuilt_table, "a23_seeded_rules": seeded, "m30_provider_safety": provider_safety, "m32_golden_scores": golden_scores, "m35_unique_citations": unique_citations,
}
