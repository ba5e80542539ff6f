"""Decision rules over whole tables: materiality, event kinds, entities, the publication gate, grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..bindings import ALIASES, documents, facts, insights, mentions, sources, statements, with_tables
from ..domains import AS_OF
from ..functions import grounding, intelligence
from ..functions.rules import NOISE_PATHS, NOISE_TITLES, any_contains, folded
from ..operators import dictionary


def materiality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = intelligence.materiality(statements(spark, sf_dir), AS_OF)
    return rated.select("code", "relevance", "impact", "timeliness", "evidence", "penalty", "suppressed", "questions", "total", "eligible")


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", F.trim("headline"), F.trim("span")))
    return statements(spark, sf_dir).select("code", text.alias("s"), "fact_type").select("code", intelligence.event_type(F.col("s"), F.col("fact_type")).alias("event_type"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = intelligence.resolved(mentions(spark, sf_dir), intelligence.entity_aliases(spark))
    return named.select("id", "resolution.status", "resolution.entities")


def attribution_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a claim from being approved without a person: unclear, mixed or wrong legal entities.

    A claim and the span that it cites are resolved alike; competitors named in the claim must
    be named in the span, and no mark of who is taken for them may stand there.
    """
    alias = F.element_at(F.array(*map(F.lit, ALIASES)), (F.col("id") * 3 % len(ALIASES) + 1).cast("int"))
    evidence = F.when(F.col("id") % 4 == 0, F.col("text")).when(F.col("id") % 4 == 1, "nothing named").otherwise(alias)
    m = mentions(spark, sf_dir).select("id", "market", "text", evidence.alias("evidence"))
    sides = m.select("id", "market", F.explode(F.array(F.struct(F.lit("c").alias("side"), "text"), F.struct(F.lit("f").alias("side"), F.col("evidence").alias("text")))).alias("x")).select("id", "market", "x.side", "x.text")
    at = lambda side, value: F.max(F.when(F.col("side") == side, value))
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    r = intelligence.resolved(sides, intelligence.entity_aliases(spark)).groupBy("id").agg(at("c", F.col("resolution")).alias("c"), at("f", F.col("resolution")).alias("f"), at("f", blank).alias("blank"))
    hits = dictionary.found(sides.select("id", "side", "text"), "text", intelligence.registry_names(spark), "alias")
    name = lambda side, marker: F.collect_set(F.when((F.col("side") == side) & (F.col("marker") == marker), F.col("name")))
    known = hits.groupBy("id").agg(name("c", False).alias("said"), name("f", False).alias("shown"), name("f", True).alias("marked"))
    r = r.join(known, "id", "left").withColumn("named", F.col("id") % 3 == 0)
    either = lambda status: (F.col("c.status") == status) | (F.col("f.status") == status)
    single = lambda side: (F.col(f"{side}.entities") != "") & ~F.contains(f"{side}.entities", F.lit(","))
    some = lambda found: F.coalesce(F.size(found) > 0, F.lit(False))
    marks = F.array_compact(F.array(
        F.when(either("AMBIGUOUS"), F.lit("AMBIGUOUS_ENTITY")), F.when(either("CONFLICT") | some(F.array_intersect("said", "marked")), F.lit("CONFUSABLE_ENTITY")), F.when(either("MULTIPLE"), F.lit("MULTIPLE_ENTITIES")),
        F.when((F.col("f.status") == "UNRESOLVED") & F.col("named"), F.lit("UNRESOLVED_NAMED_ENTITY")), F.when(single("c") & single("f") & (F.col("c.entities") != F.col("f.entities")), F.lit("ENTITY_MISMATCH")),
        F.when(~F.col("blank") & some(F.array_except("said", "shown")), F.lit("SUBJECT_NOT_IN_EVIDENCE")),
    ))
    return r.select("id", F.array_join(marks, ",").alias("warnings"), (F.size(marks) > 0).alias("blocked"))


def confusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold marks of a company that is easily taken for a competitor, and whether they name that competitor too."""
    hits = dictionary.found(mentions(spark, sf_dir).select("id", "text"), "text", intelligence.registry_names(spark), "alias")
    of = lambda column, marker: F.array_sort(F.collect_set(F.when(F.col("marker") == marker, F.col(column))))
    known = hits.groupBy("id").agg(of("alias", True).alias("m"), of("other", True).alias("o"), of("name", True).alias("w"), of("name", False).alias("n")).where("size(m) > 0")
    return known.select("id", F.array_join("m", "; ").alias("markers"), F.array_join("o", "; ").alias("others"), F.arrays_overlap("w", "n").alias("mixed"))


def publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = insights(spark, sf_dir).select("insight_id", intelligence.publication_findings().alias("f"))
    return found.select("insight_id", F.array_join("f", ",").alias("findings"), intelligence.publication_disposition(F.col("f")).alias("disposition"))


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insights of a month as one edition: what is ready, to watch or rejected, and what may be published."""
    month = F.date_format(F.get("published", 0), "yyyy-MM")
    rated = insights(spark, sf_dir).select(F.coalesce(month, F.lit("UNDATED")).alias("month"), intelligence.publication_disposition(intelligence.publication_findings()).alias("d"))
    g = rated.groupBy("month").agg(F.count_if(F.col("d") == "DECISION_READY").alias("ready"), F.count_if(F.col("d") == "WATCH").alias("watch"), F.count_if(F.col("d") == "REJECT").alias("rejected"))
    return g.withColumn("status", F.when(F.col("ready") >= 3, "READY").when(F.col("ready") + F.col("watch") >= 1, "WATCH_BRIEF").otherwise("INSUFFICIENT_EVIDENCE"))


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines and addresses that hold no intelligence, by the first reason."""
    s = statements(spark, sf_dir).select("code", F.when(F.col("pos") % 6 == 0, "Thông báo nghỉ Tết 2026").when(F.col("pos") % 6 == 1, F.upper(F.lit("Office closure notice"))).otherwise(F.col("headline")).alias("title"), F.concat(F.lit("https://x.example"), F.when(F.col("pos") % 5 == 0, "/lifestyle/").otherwise("/news/"), "code").alias("url"))
    reason = F.when(any_contains(folded(F.col("url")), NOISE_PATHS), "PATH").when(any_contains(folded(F.col("title")), NOISE_TITLES), "TITLE")
    return s.select("code", reason.alias("reason")).where("reason is not null")


NEWS_LABELS = ("PRODUCT_LAUNCH", "FEE_BENEFIT_COMMISSION_CHANGE", "PRODUCT_REGULATION", "SALES_DATA", "DISTRIBUTION_CHANNEL")


def news_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which facts are current news of the last 30 days; the first reason against one counts."""
    docs = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "text")
    s = statements(spark, sf_dir).join(docs, "doc_id")
    start = F.date_sub(F.lit(AS_OF).cast("date"), 29)
    safe = (F.col("entity_status") == "RESOLVED") | F.col("company").isNull()
    said = F.lower(F.concat_ws(" ", F.trim("headline"), F.trim("span")))
    reason = (
        F.when(F.col("pos") % 19 == 18, "INACTIVE").when(F.col("parse_status") != "OK", "NOT_PARSED").when(F.col("sample"), "SAMPLE").when(F.col("duplicate"), "DUPLICATE").when(~safe, "ATTRIBUTION")
        .when(~F.col("full_text") | (F.col("text_chars") < intelligence.LEAST_CHARS), "NO_FULL_TEXT").when(F.col("authority").isin("UNKNOWN", "SOCIAL_OR_BLOG"), "AUTHORITY")
        .when(F.col("published").isNull() | (F.col("published") < start) | (F.col("published") > F.lit(AS_OF).cast("date")), "OUTSIDE_CADENCE")
        .when((F.col("status") != "CONFIRMED") | ~F.arrays_overlap("labels", F.array(*map(F.lit, NEWS_LABELS))), "NOT_RELEVANT")
        .when(F.length(F.trim("span")) < intelligence.LEAST_SPAN, "SHORT_SPAN").when(~F.contains("text", F.col("span")), "NOT_VERBATIM")
        .when(intelligence.says(said, T.NON_LIFE), "NON_LIFE").otherwise("ELIGIBLE")
    )
    return s.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


#: Made-up endings of evidence and made-up claims, so that every outcome of the gate occurs.
TAILS = ("Rate 12.5% on 2026-07-01 for “Plan A”", "tổng 10,000 tại 2026", "ngày 1 tháng 8 năm 2026, 25.000 khách hàng", "no figures here", "On 2026年7月1日 “An Tâm” began at 3%")
CLAIMS = ("Growth was 12,5% on 01/07/2026", "It paid 10.000", "“Plan A” and “this product” began", "Now 52.000 customers", "From 2026-08-01 on", "Nothing to check")


def grounding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact's claim against the fact that it cites: the worst thing that its evidence lacks."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    i = F.col("doc_id") + F.col("pos")
    s = facts(spark, sf_dir).select("code", F.concat_ws("\n", "span", pick(TAILS, i), "company").alias("evidence"), pick(CLAIMS, F.floor(i / 2)).alias("claim"), F.when(i % 23 == 0, F.array().cast("array<string>")).when(i % 29 == 0, F.array(F.lit("F-0"))).otherwise(F.array("code")).alias("cited"))
    return s.select("code", grounding.gate(F.col("claim"), F.col("evidence"), F.col("cited"), F.array("code")).alias("status"))


VERDICTS = ("ENTAILED", "ENTAILED", "NEUTRAL", "CONTRADICTED")


def insight_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both languages of an insight through the grounding gate, then what the verifier said of each."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    i = F.col("doc_id") + F.col("pos")
    s = facts(spark, sf_dir).select("code", i.alias("i"), F.concat_ws("\n", F.lit(TAILS[0]), F.lit(TAILS[1])).alias("evidence"), pick(CLAIMS, i).alias("vi"), pick(CLAIMS, F.floor(i / 3)).alias("en"))
    l1 = lambda c: grounding.gate(F.col(c), F.col("evidence"), F.array("code"), F.array("code"))
    verdicts = F.array(pick(VERDICTS, F.col("i")), pick(VERDICTS, F.floor(F.col("i") / 4)))
    status = (
        F.when((l1("vi") != "PASS") | (l1("en") != "PASS"), "L1_REJECTED").when(F.array_contains(verdicts, "NEUTRAL"), "VERIFIER_REQUIRED")
        .when(F.array_contains(verdicts, "CONTRADICTED"), "L2_REJECTED").otherwise("VERIFIED")
    )
    return s.select("code", status.alias("status"))


def golden_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules say of a golden case: its kind, whether it is publishable, and its band of materiality."""
    rated = intelligence.materiality(statements(spark, sf_dir), AS_OF)
    kind = intelligence.event_type(F.col("s"), F.col("fact_type"))
    band = F.when(F.col("total") >= 75, "HIGH").when(F.col("total") >= 55, "MEDIUM").when(F.col("total") >= 35, "LOW").otherwise("NONE")
    return rated.groupBy(kind.alias("event_type"), "eligible", band.alias("band")).agg(F.count("*").alias("n"))


def dates_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date that a model gave for each fact, against the dates of its evidence."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    said = ("on the 1st July 2026", "July 2nd, 2026", "3.7.2026", "ngày 4 tháng 7 năm 2026", "2026-7-5", "31 February 2026")
    given = ("2026-07-01", "2026-07-02", "", "2026-07-04", "2026-07-05", "soon", "2026-07-03")
    s = facts(spark, sf_dir).select("code", pick(said, F.col("pos")).alias("text"), pick(given, F.col("doc_id") + F.col("pos")).alias("given"))
    return s.select("code", grounding.grounded(F.col("given"), F.col("text")).alias("status"), F.array_join(grounding.wide_dates(F.col("text")).cast("array<string>"), ",").alias("dates"))


def language_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statements(spark, sf_dir).select("code", F.concat("headline", F.lit(" the market for "), F.lit("“giá và quy định của thị trường”"), F.when(F.col("pos") % 3 == 0, " của thị trường").otherwise("")).alias("t"))
    return s.select("code", intelligence.likely_language(F.col("t"), True).alias("vietnamese"), intelligence.likely_language(F.col("t"), False).alias("english"))


def inferred_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authority and market of a source from its code, its name and its host."""
    s = sources(spark, sf_dir)
    kinds = ("MOF_", "IAV_", "SOCIAL_", "STATUTORY_", "NEWS_")
    code = F.concat(F.element_at(F.array(*map(F.lit, kinds)), (F.col("n") % 5 + 1).cast("int")), F.upper("code"), F.element_at(F.array(*map(F.lit, ("_VN", "_JP", "", "_GLOBAL"))), (F.floor(F.col("n") / 5) % 4 + 1).cast("int")))
    name = F.when(F.col("n") % 7 == 0, "Longevity Institute").when(F.col("n") % 7 == 1, "McKinsey notes").otherwise("Daily")
    r = s.select("code", code.alias("k"), F.lower(name).alias("name"), F.when(F.col("n") % 3 == 0, "a.vn").otherwise("www.linkedin.com").alias("host"))
    return r.select("code", grounding.inferred_authority().alias("authority"), grounding.inferred_market().alias("market"))


QUERIES = {
    "m06_materiality": materiality, "m07_event_types": event_types, "m08_entity_resolution": entities, "m09_attribution_warnings": attribution_warnings, "m10_confusable": confusable, "m17_publication_gate": publication, "m18_edition_gate": editions, "c10_noise": noise, "c14_news_policy": news_policy,
    "m12_grounding_gate": grounding_gate, "m20_insight_gate": insight_gate, "m31_golden_predictions": golden_predictions, "k08_date_grounding": dates_in_text, "k34_language_purity": language_purity, "m11_source_inference": inferred_sources,
}

_S = "lower(concat_ws(' ', trim(headline), trim(span)))"
_EVENT = f"""CASE WHEN {T.word_sql('s', T.EVENT_PROMOTION)} THEN 'MARKETING_PROMOTION' WHEN {T.word_sql('s', T.EVENT_WITHDRAWAL)} AND product THEN 'PRODUCT_WITHDRAWAL' WHEN {T.word_sql('s', T.EVENT_NEED)} THEN 'CUSTOMER_NEED_SIGNAL'
  WHEN {T.word_sql('s', T.EVENT_REGULATION)} THEN 'REGULATORY_CHANGE' WHEN fact_type = 'METRIC' AND performance THEN 'COMPETITIVE_PERFORMANCE' WHEN {T.word_sql('s', T.EVENT_SERVICE)} AND (change OR launch) THEN 'SERVICE_EXPERIENCE_CHANGE'
  WHEN {T.word_sql('s', T.EVENT_BENEFIT)} AND change THEN 'BENEFIT_CHANGE' WHEN {T.word_sql('s', T.EVENT_PRICE)} AND change THEN 'PRICING_CHANGE' WHEN launch AND product THEN 'PRODUCT_LAUNCH'
  WHEN {T.word_sql('s', T.EVENT_DISTRIBUTION)} AND (change OR launch) THEN 'DISTRIBUTION_CHANGE' WHEN product AND change THEN 'PRODUCT_CHANGE' WHEN performance OR fact_type = 'METRIC' THEN 'COMPETITIVE_PERFORMANCE'
  WHEN {T.word_sql('s', T.EVENT_CORPORATE)} THEN 'CORPORATE_NEWS' ELSE 'OTHER' END"""
_LABEL = "(list_contains(labels, '{}') OR fact_type = '{}')"
_MATERIAL = f"""also a AS (SELECT *, {_S} AS s, lower(trim(headline)) AS t, length(trim(span, ' ')) AS span_chars, date_diff('day', published, DATE '{AS_OF}') AS age FROM said),
  b AS (SELECT *, {T.word_sql('s', T.OFFER)} AS offer, {T.word_sql('s', T.REGULATION)} AS regulated, {T.word_sql('s', T.DISTRIBUTION_INNOVATION)} AND {T.word_sql('s', T.DISTRIBUTION_CHANGE)} AS distribution,
    {_LABEL.format('SALES_DATA', 'METRIC')} AS sales, full_text AND text_chars >= 600 AS whole,
    ({T.word_sql('t', T.BANKING)} AND NOT {T.word_sql('t', T.INSURANCE)}) OR ({T.word_sql('s', T.BANKING)} AND NOT {T.word_sql('s', T.INSURANCE)}) AS banking, {T.word_sql('s', T.NON_LIFE)} AS non_life FROM a),
  c AS (SELECT *, {_LABEL.format('PRODUCT_LAUNCH', 'PRODUCT_LAUNCH')} AND offer AND {T.word_sql('s', T.LAUNCH_ACTION)} AS launch, {_LABEL.format('FEE_BENEFIT_COMMISSION_CHANGE', 'FEE_CHANGE')} AND offer AND {T.word_sql('s', T.OFFER_CHANGE)} AS fee,
    {_LABEL.format('PRODUCT_REGULATION', 'REGULATION')} AND regulated AS regulation FROM b),
  d AS (SELECT *, CASE WHEN fee THEN 29 WHEN launch THEN 28 WHEN regulation THEN 27 WHEN distribution THEN 24 WHEN sales THEN 12 WHEN offer THEN 16 ELSE 0 END AS r,
    CASE WHEN regulation THEN 22 WHEN fee THEN 21 WHEN launch THEN 19 WHEN distribution THEN 17 WHEN sales THEN 9 ELSE 0 END AS i FROM c),
  e AS (SELECT code, status, authority, span_chars, whole, CASE WHEN offer AND r > 0 THEN least(30, r + 1) ELSE r END AS relevance,
    least(25, i + CASE WHEN product IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN company IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN regexp_matches(s, '(^|[^a-z])[0-9]($|[^a-z])') THEN 2 ELSE 0 END) AS impact,
    CASE WHEN age IS NULL THEN 3 WHEN age < 0 THEN 10 WHEN age <= 14 THEN 15 WHEN age <= 30 THEN 12 WHEN age <= 90 THEN 8 WHEN age <= 180 THEN 4 ELSE 1 END AS timeliness,
    least(20, CASE WHEN parse_status = 'OK' THEN 4 ELSE 0 END + CASE WHEN whole THEN 7 WHEN text_chars >= 600 THEN 4 ELSE 0 END + CASE WHEN span_chars >= 160 THEN 6 WHEN span_chars >= 80 THEN 4 WHEN span_chars >= 30 THEN 1 ELSE 0 END
      + CASE WHEN status = 'CONFIRMED' THEN 3 ELSE 0 END + CASE WHEN company IS NOT NULL OR product IS NOT NULL THEN 1 ELSE 0 END) AS evidence,
    greatest(-60, CASE WHEN duplicate THEN -40 ELSE 0 END + CASE WHEN status = 'OUT_OF_SCOPE' THEN -40 ELSE 0 END + CASE WHEN parse_status <> 'OK' THEN -25 ELSE 0 END + CASE WHEN banking THEN -40 ELSE 0 END + CASE WHEN non_life THEN -40 ELSE 0 END + CASE WHEN NOT whole THEN -18 ELSE 0 END) AS penalty,
    concat_ws(',', CASE WHEN duplicate THEN 'duplicate' END, CASE WHEN status = 'OUT_OF_SCOPE' THEN 'scope' END, CASE WHEN parse_status <> 'OK' THEN 'parse' END, CASE WHEN banking THEN 'banking' END, CASE WHEN non_life THEN 'non_life' END) AS suppressed,
    concat_ws(',', CASE WHEN launch OR fee OR offer THEN '1' END, CASE WHEN sales OR {T.word_sql('s', T.PATTERN)} THEN '2' END, CASE WHEN regulation OR regulated THEN '3' END, CASE WHEN distribution THEN '4' END,
      CASE WHEN launch OR fee OR regulation OR distribution THEN '5' END, CASE WHEN launch OR fee THEN '6' END, CASE WHEN {T.word_sql('s', T.COUNTER_EVIDENCE)} THEN '7' END) AS questions FROM d)
  SELECT code, CAST(relevance AS INT) AS relevance, CAST(impact AS INT) AS impact, CAST(timeliness AS INT) AS timeliness, CAST(evidence AS INT) AS evidence, CAST(penalty AS INT) AS penalty, suppressed, questions, CAST(total AS INT) AS total,
    suppressed = '' AND whole AND span_chars >= 80 AND status = 'CONFIRMED' AND authority NOT IN ('SOCIAL_OR_BLOG', 'UNKNOWN') AND questions <> '' AND total >= 60 AS eligible
  FROM (SELECT *, greatest(0, least(100, relevance + impact + timeliness + evidence + penalty)) AS total FROM e)"""
_ENTITY_ROWS = ", ".join(f"('{e[0]}', '{e[2]}', '{T.family(e[3])}', {shared}, '{alias}', '{T.alternatives([alias])}')" for e in T.ENTITIES for shared, aliases in ((0, e[4]), (1, e[5])) for alias in aliases)


def _resolved(texts: str, name: str) -> str:
    return f"""{name}_e AS (SELECT * FROM (VALUES {_ENTITY_ROWS}) v(entity, country, brand, shared, alias, pattern)), {name}_near AS MATERIALIZED (SELECT id, lower(text) AS t, market, e.* FROM {texts}, {name}_e e WHERE contains(lower(text), alias)),
      {name}_hits AS (SELECT DISTINCT id, market, entity, country, brand, shared FROM {name}_near WHERE regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}])' || pattern || '($|[^\\p{{L}}\\p{{N}}])')),
      {name}_g AS (SELECT id, list(entity ORDER BY entity) FILTER (shared = 0) AS own, count(DISTINCT brand) FILTER (shared = 0) AS brands, list(entity ORDER BY entity) FILTER (shared = 1) AS common,
        list(entity ORDER BY entity) FILTER (shared = 1 AND country = market AND market NOT IN ('GLOBAL', 'REGIONAL', 'MULTI', 'MULTI_MARKET', 'UNKNOWN')) AS here FROM {name}_hits GROUP BY id),
      {name} AS (SELECT m.id, CASE WHEN len(own) > 1 AND brands < len(own) THEN 'CONFLICT' WHEN len(own) > 1 THEN 'MULTIPLE' WHEN len(own) = 1 THEN 'RESOLVED' WHEN common IS NULL THEN 'UNRESOLVED' WHEN len(here) = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status,
        coalesce(array_to_string(CASE WHEN own IS NOT NULL THEN own WHEN len(here) = 1 THEN here ELSE common END, ','), '') AS entities FROM {texts} m LEFT JOIN {name}_g USING (id))"""


_NAMES = [(alias, "false", name, "") for name, aliases in T.COMPETITORS for alias in aliases] + [(mark, "true", name, other) for name, other, marks in T.CONFUSABLES for mark in marks]
_REGISTRY = "reg AS (SELECT * FROM (VALUES " + ", ".join(f"('{alias}', {marker}, '{name}', '{other}', '{T.alternatives([alias])}')" for alias, marker, name, other in _NAMES) + ") r(alias, marker, name, other, pattern))"


def _named(texts: str, name: str) -> str:
    return f"""{name}_near AS MATERIALIZED (SELECT id, t, reg.* FROM (SELECT id, lower(text) AS t FROM {texts}), reg WHERE contains(t, alias)),
      {name} AS MATERIALIZED (SELECT * FROM {name}_near WHERE regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}])' || pattern || '($|[^\\p{{L}}\\p{{N}}])'))"""


_SQUEEZE = "trim(regexp_replace(replace(strip_accents(lower({})), 'đ', 'd'), '\\s+', ' ', 'g'), ' ')"
_HAS = lambda text, terms: "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"
_GATE = f"""also n AS (SELECT *, {_SQUEEZE.format('action')} AS a, ' ' || {_SQUEEZE.format('action')} || ' ' AS padded FROM insights),
  f AS (SELECT i AS insight_id, d, CASE WHEN i % 37 = 0 THEN 'UNDATED' ELSE strftime(d, '%Y-%m') END AS month, list_filter([CASE WHEN len(cited) = 0 THEN 'NO_CITATIONS' END, CASE WHEN len(cited) > 0 AND len(list_filter(cited, lambda x: NOT list_contains(resolved, x))) > 0 THEN 'UNRESOLVED_EVIDENCE' END,
    CASE WHEN department <> 'PRODUCT' OR audience = 'SALES_TEAM' THEN 'WRONG_DEPARTMENT_AUDIENCE' END,
    CASE WHEN owner = 'example life' OR ((contains(padded, 'example life') OR contains(padded, 'vi du nhan tho')) AND {_HAS('padded', T.DIRECTIVES)}) THEN 'EXTERNAL_ENTITY_AS_ACTION_OWNER' END,
    CASE WHEN NOT ({' OR '.join(f"(theme = '{theme}' AND event_type IN ({', '.join(map(repr, kinds))}))" for theme, kinds in T.THEME_EVENTS.items())}) THEN 'CHAPTER_CATEGORY_CONTAMINATION' END,
    CASE WHEN future AND deadline < DATE '1995-06-01' THEN 'ACTION_DEADLINE_PASSED' END, CASE WHEN future AND effective < DATE '1995-06-01' THEN 'EFFECTIVE_DATE_PASSED' END, CASE WHEN question = 'OTHER' THEN 'MISSING_PRODUCT_KIQ' END,
    CASE WHEN n_events = 0 THEN 'MISSING_EVENT_PROVENANCE' END, CASE WHEN n_sources = 0 THEN 'MISSING_SOURCE_PROVENANCE' END, CASE WHEN trend AND n_events < 2 THEN 'TREND_INSUFFICIENT_EVENTS' END,
    CASE WHEN trend AND n_sources < 2 THEN 'TREND_INSUFFICIENT_SOURCES' END, CASE WHEN NOT trend AND n_sources = 1 THEN 'SINGLE_SOURCE_WATCH' END, CASE WHEN a = '' THEN 'MISSING_ACTION' END,
    CASE WHEN a <> '' AND {_HAS('a', T.MONITORING)} AND NOT {_HAS('a', T.DECIDING)} THEN 'GENERIC_MONITOR_ACTION' END, CASE WHEN i % 37 = 0 OR i % 41 = 0 OR d < DATE '1992-03-01' OR d > DATE '1998-06-30' THEN 'STALE_INPUT' END,
    CASE WHEN i % 43 = 0 OR i % 47 = 0 THEN 'LEGACY_VERSION_MIX' END], lambda x: x IS NOT NULL) AS f FROM n),
  g AS (SELECT *, CASE WHEN len(list_filter(f, lambda x: x <> 'SINGLE_SOURCE_WATCH')) > 0 THEN 'REJECT' WHEN len(f) > 0 THEN 'WATCH' ELSE 'DECISION_READY' END AS disposition FROM f)"""
_CASE = lambda n, values: "CASE " + n + " % " + str(len(values)) + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"
_TOKENS = "list_distinct(list_transform(regexp_extract_all({}, '([0-9]+(?:[.,][0-9]+)*\\s*%?)', 1), lambda t: regexp_replace(t, '\\s+', '', 'g')))"
_READ = """flatten(list_transform({}, lambda t: list_distinct(list_filter([regexp_replace(CASE WHEN contains(replace(regexp_replace(replace(t, '%', ''), '[.,]([0-9]+[.,])', '\\1', 'g'), ',', '.'), '.')
  THEN regexp_replace(regexp_replace(replace(replace(t, '%', ''), ',', '.'), '0+$', ''), '\\.$', '') ELSE replace(t, '%', '') END, '^0+([0-9])', '\\1') || CASE WHEN contains(t, '%') THEN '%' ELSE '' END,
  CASE WHEN regexp_full_match(replace(t, '%', ''), '[0-9]{{1,3}}([.,][0-9]{{3}})+') OR NOT regexp_matches(replace(t, '%', ''), '[.,]') THEN regexp_replace(regexp_replace(replace(t, '%', ''), '[.,]', '', 'g'), '^0+([0-9])', '\\1') || CASE WHEN contains(t, '%') THEN '%' ELSE '' END END], lambda x: x IS NOT NULL))))"""
_DATE_SIGNS = "\\d{4}年\\d{1,2}月\\d{1,2}日|\\d{4}-\\d{1,2}-\\d{1,2}|\\d{1,2}/\\d{1,2}/\\d{4}"
_FOUND_DATES = """list_distinct(list_filter(list_concat(list_transform(regexp_extract_all({0}, '(\\d{{4}}-\\d{{1,2}}-\\d{{1,2}})', 1), lambda x: try_strptime(x, '%Y-%m-%d')), list_concat(
  list_transform(regexp_extract_all({0}, '(\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})', 1), lambda x: try_strptime(x, '%d/%m/%Y')), list_concat(
  list_transform(regexp_extract_all(lower({0}), 'ngày\\s+(\\d{{1,2}}\\s+tháng\\s+\\d{{1,2}}\\s+năm\\s+\\d{{4}})', 1), lambda x: try_strptime(regexp_replace(regexp_replace(x, '\\s+(tháng|năm)\\s+', '/', 'g'), '\\s', '', 'g'), '%d/%m/%Y')),
  list_transform(regexp_extract_all({0}, '(\\d{{4}}年\\d{{1,2}}月\\d{{1,2}}日)', 1), lambda x: try_strptime(replace(replace(replace(x, '年', '-'), '月', '-'), '日', ''), '%Y-%m-%d'))))), lambda x: x IS NOT NULL))"""
ORACLE_SQL = {
    "m06_materiality": with_tables("said", _MATERIAL),
    "m07_event_types": with_tables("said", f"""SELECT code, {_EVENT} AS event_type FROM (SELECT *, {T.word_sql('s', T.EVENT_CHANGE)} AS change, {T.word_sql('s', T.EVENT_LAUNCH)} AS launch, {T.word_sql('s', T.EVENT_PRODUCT)} AS product,
      {T.word_sql('s', T.EVENT_PERFORMANCE)} AS performance FROM (SELECT code, fact_type, {_S} AS s FROM said))"""),
    "m08_entity_resolution": with_tables("mentions", f"also {_resolved('mentions', 'x')} SELECT id, status, entities FROM x"),
    "m09_attribution_warnings": with_tables("mentions", f"""also said AS (SELECT id, market, CASE id % 4 WHEN 0 THEN text WHEN 1 THEN 'nothing named' ELSE {_CASE('(id * 3)', ALIASES)} END AS text FROM mentions), {_resolved('mentions', 'x')}, {_resolved('said', 'y')},
      {_REGISTRY}, {_named('mentions', 'c')}, {_named('said', 'f')},
      subject AS (SELECT DISTINCT c.id FROM c WHERE NOT marker AND name NOT IN (SELECT name FROM f WHERE f.id = c.id AND NOT marker)), taken AS (SELECT DISTINCT c.id FROM c JOIN f ON f.id = c.id AND f.name = c.name AND f.marker AND NOT c.marker)
      SELECT id, w AS warnings, w <> '' AS blocked FROM (SELECT x.id, concat_ws(',', CASE WHEN 'AMBIGUOUS' IN (x.status, y.status) THEN 'AMBIGUOUS_ENTITY' END, CASE WHEN 'CONFLICT' IN (x.status, y.status) OR taken.id IS NOT NULL THEN 'CONFUSABLE_ENTITY' END, CASE WHEN 'MULTIPLE' IN (x.status, y.status) THEN 'MULTIPLE_ENTITIES' END,
        CASE WHEN y.status = 'UNRESOLVED' AND x.id % 3 = 0 THEN 'UNRESOLVED_NAMED_ENTITY' END, CASE WHEN x.entities <> '' AND NOT contains(x.entities, ',') AND y.entities <> '' AND NOT contains(y.entities, ',') AND x.entities <> y.entities THEN 'ENTITY_MISMATCH' END,
        CASE WHEN subject.id IS NOT NULL THEN 'SUBJECT_NOT_IN_EVIDENCE' END) AS w FROM x JOIN y USING (id) LEFT JOIN subject ON subject.id = x.id LEFT JOIN taken ON taken.id = x.id)"""),
    "m10_confusable": with_tables("mentions", f"""also {_REGISTRY}, {_named('mentions', 'c')} SELECT id, string_agg(DISTINCT alias, '; ' ORDER BY alias) FILTER (marker) AS markers, string_agg(DISTINCT other, '; ' ORDER BY other) FILTER (marker) AS others,
      len(list_intersect(list(name) FILTER (marker), list(name) FILTER (NOT marker))) > 0 AS mixed FROM c GROUP BY id HAVING bool_or(marker)"""),
    "m17_publication_gate": with_tables("insights", f"{_GATE} SELECT insight_id, array_to_string(f, ',') AS findings, disposition FROM g"),
    "m18_edition_gate": with_tables("insights", f"""{_GATE} SELECT *, CASE WHEN ready >= 3 THEN 'READY' WHEN ready + watch >= 1 THEN 'WATCH_BRIEF' ELSE 'INSUFFICIENT_EVIDENCE' END AS status FROM
      (SELECT month, count(*) FILTER (disposition = 'DECISION_READY') AS ready, count(*) FILTER (disposition = 'WATCH') AS watch, count(*) FILTER (disposition = 'REJECT') AS rejected FROM g GROUP BY month)"""),
    "c10_noise": with_tables("said", "SELECT code, CASE WHEN pos % 5 = 0 THEN 'PATH' ELSE 'TITLE' END AS reason FROM said WHERE pos % 5 = 0 OR pos % 6 IN (0, 1)"),
    "c14_news_policy": with_tables("said", f"""SELECT CASE WHEN pos % 19 = 18 THEN 'INACTIVE' WHEN parse_status <> 'OK' THEN 'NOT_PARSED' WHEN sample THEN 'SAMPLE' WHEN duplicate THEN 'DUPLICATE' WHEN company IS NOT NULL AND entity_status <> 'RESOLVED' THEN 'ATTRIBUTION'
      WHEN NOT full_text OR text_chars < 600 THEN 'NO_FULL_TEXT' WHEN authority IN ('UNKNOWN', 'SOCIAL_OR_BLOG') THEN 'AUTHORITY' WHEN published IS NULL OR published NOT BETWEEN DATE '{AS_OF}' - 29 AND DATE '{AS_OF}' THEN 'OUTSIDE_CADENCE'
      WHEN status <> 'CONFIRMED' OR NOT list_has_any(labels, {list(NEWS_LABELS)}) THEN 'NOT_RELEVANT' WHEN length(trim(span, ' ')) < 80 THEN 'SHORT_SPAN' WHEN {T.word_sql(_S, T.NON_LIFE)} THEN 'NON_LIFE' ELSE 'ELIGIBLE' END AS reason, count(*) AS n FROM said GROUP BY ALL"""),
    "m12_grounding_gate": with_tables("facts", f"""also x AS (SELECT code, doc_id + pos AS i, concat_ws(chr(10), span, {_CASE('(doc_id + pos)', TAILS)}, company) AS evidence, {_CASE('((doc_id + pos) // 2)', CLAIMS)} AS claim FROM facts),
      y AS (SELECT *, trim(regexp_replace(claim, '{_DATE_SIGNS}', ' ', 'g')) AS bare, {_FOUND_DATES.format('claim')} AS cd, {_FOUND_DATES.format('evidence')} AS ed FROM x),
      z AS (SELECT *, {_READ.format(_TOKENS.format('evidence'))} AS er, {_TOKENS.format('bare')} AS ct FROM y)
      SELECT code, CASE WHEN i % 23 = 0 THEN 'FAIL_NO_CITATION' WHEN i % 29 = 0 THEN 'FAIL_UNKNOWN_CITATION' WHEN contains(claim, '“Plan A”') AND NOT contains(evidence, 'Plan A') THEN 'FAIL_NAME_NOT_IN_EVIDENCE'
        WHEN len(list_filter(cd, lambda d: NOT list_contains(ed, d))) > 0 THEN 'FAIL_DATE_NOT_IN_EVIDENCE' WHEN len(list_filter(ct, lambda t: NOT list_has_any({_READ.format('[t]')}, er))) > 0 THEN 'FAIL_NUMBER_NOT_IN_EVIDENCE' ELSE 'PASS' END AS status FROM z"""),
    "m20_insight_gate": with_tables("facts", """SELECT code, CASE WHEN i % 6 IN (3, 4) OR (i // 3) % 6 IN (3, 4) THEN 'L1_REJECTED' WHEN i % 4 = 2 OR (i // 4) % 4 = 2 THEN 'VERIFIER_REQUIRED' WHEN i % 4 = 3 OR (i // 4) % 4 = 3 THEN 'L2_REJECTED' ELSE 'VERIFIED' END AS status FROM (SELECT code, doc_id + pos AS i FROM facts)"""),
    "m31_golden_predictions": with_tables("said", _MATERIAL.split("SELECT code, CAST(relevance AS INT)")[0] + f""", ev AS (SELECT code, {_EVENT} AS event_type FROM (SELECT *, {T.word_sql('s', T.EVENT_CHANGE)} AS change, {T.word_sql('s', T.EVENT_LAUNCH)} AS launch, {T.word_sql('s', T.EVENT_PRODUCT)} AS product,
      {T.word_sql('s', T.EVENT_PERFORMANCE)} AS performance FROM (SELECT code, fact_type, s FROM a)))
      SELECT event_type, suppressed = '' AND whole AND span_chars >= 80 AND status = 'CONFIRMED' AND authority NOT IN ('SOCIAL_OR_BLOG', 'UNKNOWN') AND questions <> '' AND total >= 60 AS eligible,
        CASE WHEN total >= 75 THEN 'HIGH' WHEN total >= 55 THEN 'MEDIUM' WHEN total >= 35 THEN 'LOW' ELSE 'NONE' END AS band, count(*) AS n
      FROM (SELECT *, greatest(0, least(100, relevance + impact + timeliness + evidence + penalty)) AS total FROM e) JOIN ev USING (code) GROUP BY ALL"""),
    "k08_date_grounding": with_tables("facts", """SELECT code, CASE WHEN g = '' THEN 'ABSENT' WHEN try_strptime(g, '%Y-%m-%d') IS NULL THEN 'INVALID_FORMAT' WHEN d = g THEN 'GROUNDED' ELSE 'UNGROUNDED' END AS status, d AS dates FROM (SELECT code,
      CASE pos % 6 WHEN 5 THEN '' ELSE '2026-07-0' || (pos % 6 + 1) END AS d, ['2026-07-01', '2026-07-02', '', '2026-07-04', '2026-07-05', 'soon', '2026-07-03'][CAST((doc_id + pos) % 7 + 1 AS INT)] AS g FROM facts)"""),
    "k34_language_purity": with_tables("said", f"""SELECT code, en < 3 AS vietnamese, vi < 3 AND NOT (marked AND vi >= 1) AS english FROM (SELECT code, regexp_matches(t, '[ăâđêôơưĂÂĐÊÔƠƯà-ỹÀ-Ỹ]') AS marked,
      len(list_filter(w, lambda x: list_contains({list(T.ENGLISH_WORDS)}, x))) AS en, len(list_filter(w, lambda x: list_contains({list(T.VIETNAMESE_WORDS)}, x))) AS vi
      FROM (SELECT *, regexp_extract_all(lower(t), '(\\p{{L}}+(?:-\\p{{L}}+)?)', 1) AS w FROM (SELECT code, headline || ' the market for ' || CASE WHEN pos % 3 = 0 THEN ' của thị trường' ELSE '' END AS t FROM said)))"""),
    "m11_source_inference": with_tables("src", """SELECT code, CASE n % 5 WHEN 3 THEN 'STATUTORY_DISCLOSURE' WHEN 0 THEN 'REGULATOR' WHEN 1 THEN 'INDUSTRY_BODY' ELSE CASE WHEN n % 7 = 0 THEN 'SPECIALIST_RESEARCH' WHEN n % 7 = 1 THEN 'PROFESSIONAL_SERVICES'
      WHEN n % 5 = 2 OR n % 3 <> 0 THEN 'SOCIAL_OR_BLOG' ELSE 'UNKNOWN' END END AS authority, CASE (n // 5) % 4 WHEN 0 THEN 'VN' WHEN 3 THEN 'GLOBAL' WHEN 1 THEN CASE WHEN n % 7 = 1 THEN 'GLOBAL' ELSE 'JP' END ELSE CASE WHEN n % 7 = 1 THEN 'GLOBAL' WHEN n % 3 = 0 THEN 'VN' ELSE 'UNKNOWN' END END AS market FROM src"""),
}
