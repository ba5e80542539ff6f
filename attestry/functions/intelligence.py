"""Decision rules over statements: how material, what kind of event, which legal entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..operators import dictionary
from .rules import steps

LEAST_CHARS, LEAST_SPAN, PUBLISH = 600, 80, 60


def says(text: Column, terms) -> Column:
    """Whether a lower-case text holds one of the terms as a word or phrase."""
    return F.coalesce(text.rlike(T.word_pattern(terms)), F.lit(False))


def event_type(text: Column, fact_type: Column) -> Column:
    """The kind of product event: the first of an ordered list of keyword rules."""
    change, launch, product = says(text, T.EVENT_CHANGE), says(text, T.EVENT_LAUNCH), says(text, T.EVENT_PRODUCT)
    performance, metric = says(text, T.EVENT_PERFORMANCE), F.coalesce(F.upper(fact_type) == "METRIC", F.lit(False))
    return (
        F.when(says(text, T.EVENT_PROMOTION), "MARKETING_PROMOTION")
        .when(says(text, T.EVENT_WITHDRAWAL) & product, "PRODUCT_WITHDRAWAL")
        .when(says(text, T.EVENT_NEED), "CUSTOMER_NEED_SIGNAL")
        .when(says(text, T.EVENT_REGULATION), "REGULATORY_CHANGE")
        .when(metric & performance, "COMPETITIVE_PERFORMANCE")
        .when(says(text, T.EVENT_SERVICE) & (change | launch), "SERVICE_EXPERIENCE_CHANGE")
        .when(says(text, T.EVENT_BENEFIT) & change, "BENEFIT_CHANGE")
        .when(says(text, T.EVENT_PRICE) & change, "PRICING_CHANGE")
        .when(launch & product, "PRODUCT_LAUNCH")
        .when(says(text, T.EVENT_DISTRIBUTION) & (change | launch), "DISTRIBUTION_CHANGE")
        .when(product & change, "PRODUCT_CHANGE")
        .when(performance | metric, "COMPETITIVE_PERFORMANCE")
        .when(says(text, T.EVENT_CORPORATE), "CORPORATE_NEWS")
        .otherwise("OTHER")
    )


def credibility(authority: Column) -> Column:
    return (
        F.when(authority.isin("REGULATOR", "STATUTORY_DISCLOSURE", "OFFICIAL_COMPANY"), 100)
        .when(authority.isin("INDUSTRY_BODY", "SPECIALIST_RESEARCH", "ESTABLISHED_MEDIA", "PROFESSIONAL_SERVICES"), 80)
        .when(authority == "OTHER_PUBLISHER", 60)
        .when(authority == "SOCIAL_OR_BLOG", 35)
        .otherwise(50)
    )


def materiality(statements: DataFrame, as_of: str) -> DataFrame:
    """Points, penalty, questions and eligibility of statements.

    Reads: headline, span, fact_type, labels, status, company, product, published, full_text,
    parse_status, duplicate, authority, text_chars.  A label counts only where the headline
    or the span says what it claims.
    """
    text = F.lower(F.concat_ws(" ", F.trim("headline"), F.trim("span")))
    label = lambda name, kind: F.array_contains("labels", name) | (F.col("fact_type") == kind)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    offer = says(F.col("s"), T.OFFER)
    df = statements.withColumn("s", text).withColumns({
        "offer": offer, "regulated": says(F.col("s"), T.REGULATION), "changed": says(F.col("s"), T.OFFER_CHANGE), "launching": says(F.col("s"), T.LAUNCH_ACTION),
        "distribution": says(F.col("s"), T.DISTRIBUTION_INNOVATION) & says(F.col("s"), T.DISTRIBUTION_CHANGE),
        "sales": label("SALES_DATA", "METRIC"),
    })
    df = df.withColumns({
        "launch": label("PRODUCT_LAUNCH", "PRODUCT_LAUNCH") & F.col("launching") & F.col("offer"),
        "fee": label("FEE_BENEFIT_COMMISSION_CHANGE", "FEE_CHANGE") & F.col("offer") & F.col("changed"),
        "regulation": label("PRODUCT_REGULATION", "REGULATION") & F.col("regulated"),
    })
    first = lambda *pairs: F.coalesce(*(F.when(F.col(c), points) for c, points in pairs), F.lit(0))
    relevance = first(("fee", 29), ("launch", 28), ("regulation", 27), ("distribution", 24), ("sales", 12), ("offer", 16))
    impact = first(("regulation", 22), ("fee", 21), ("launch", 19), ("distribution", 17), ("sales", 9))
    number = F.coalesce(F.col("s").rlike(r"(?<![a-z])(?:\d[\d.,]*|\d+\s*%)(?![a-z])"), F.lit(False))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("published"))
    fresh = F.when(age.isNull(), 3).when(age < 0, 10).otherwise(steps(age, (14, 15), (30, 12), (90, 8), (180, 4), last=1))
    span, ok = F.length(F.trim("span")), F.col("parse_status") == "OK"
    whole = F.col("full_text") & (F.col("text_chars") >= LEAST_CHARS)
    one = lambda c, points: F.when(c, points).otherwise(0)
    evidence = (
        one(ok, 4) + F.when(whole, 7).when(F.col("text_chars") >= LEAST_CHARS, 4).otherwise(0) + F.when(span >= 160, 6).when(span >= LEAST_SPAN, 4).when(span >= 30, 1).otherwise(0)
        + one(F.col("status") == "CONFIRMED", 3) + one(~blank("company") | ~blank("product"), 1)
    )
    title = F.lower(F.trim("headline"))
    banking = (says(title, T.BANKING) & ~says(title, T.INSURANCE)) | (says(F.col("s"), T.BANKING) & ~says(F.col("s"), T.INSURANCE))
    hard = (("duplicate", F.col("duplicate"), 40), ("scope", F.col("status") == "OUT_OF_SCOPE", 40), ("parse", ~ok, 25), ("banking", banking, 40), ("non_life", says(F.col("s"), T.NON_LIFE), 40))
    df = df.withColumns({
        "relevance": F.when(F.col("offer") & (relevance > 0), F.least(F.lit(30), relevance + 1)).otherwise(relevance),
        "impact": F.least(F.lit(25), impact + one(~blank("product"), 2) + one(~blank("company"), 1) + one(number, 2)),
        "timeliness": fresh, "evidence": F.least(F.lit(20), evidence),
        "suppressed": F.array_join(F.array_compact(F.array(*(F.when(c, name) for name, c, _ in hard))), ","),
        "penalty": F.greatest(F.lit(-60), sum((one(c, -points) for _, c, points in hard), F.lit(0)) + one(~whole, -18)),
        "questions": F.array_join(F.array_compact(F.array(
            F.when(F.col("launch") | F.col("fee") | F.col("offer"), "1"), F.when(F.col("sales") | says(F.col("s"), T.PATTERN), "2"), F.when(F.col("regulation") | F.col("regulated"), "3"),
            F.when(F.col("distribution"), "4"), F.when(F.col("launch") | F.col("fee") | F.col("regulation") | F.col("distribution"), "5"), F.when(F.col("launch") | F.col("fee"), "6"),
            F.when(says(F.col("s"), T.COUNTER_EVIDENCE), "7"),
        )), ","),
    })
    total = F.greatest(F.lit(0), F.least(F.lit(100), F.col("relevance") + F.col("impact") + F.col("timeliness") + F.col("evidence") + F.col("penalty")))
    eligible = (
        (F.col("suppressed") == "") & whole & (span >= LEAST_SPAN) & (F.col("status") == "CONFIRMED") & (credibility(F.col("authority")) >= 60)
        & (F.col("questions") != "") & (F.col("total") >= PUBLISH)
    )
    return df.withColumn("total", total).withColumn("eligible", F.coalesce(eligible, F.lit(False)))


def entity_aliases(spark: SparkSession) -> DataFrame:
    """(alias, entity, country, brand, shared): a row for each alias of the registry."""
    rows = [(alias, e[0], e[2], T.family(e[3]), shared) for e in T.ENTITIES for shared, aliases in ((False, e[4]), (True, e[5])) for alias in aliases]
    return spark.createDataFrame(rows, "alias string, entity string, country string, brand string, shared boolean")


def decided(own: Column, shared: Column, text: Column, market: Column) -> Column:
    """(status, entities) from the entities that a text names by own aliases and by shared ones.

    Both are arrays of (entity, country, brand).  Own aliases count first; shared ones are
    narrowed by a country.
    """
    names = lambda found: F.transform(found, lambda e: e["entity"])
    place = F.upper(F.trim(F.coalesce(market, F.lit(""))))
    here = F.filter(shared, lambda e: (e["country"] == place) & (place != "") & ~place.isin(*T.WIDE_MARKETS))
    confusable = F.size(F.array_distinct(F.transform(own, lambda e: e["brand"]))) < F.size(own)
    status = (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "UNRESOLVED").when((F.size(own) > 1) & confusable, "CONFLICT").when(F.size(own) > 1, "MULTIPLE").when(F.size(own) == 1, "RESOLVED")
        .when(F.size(shared) == 0, "UNRESOLVED").when(F.size(here) == 1, "RESOLVED").otherwise("AMBIGUOUS")
    )
    entities = F.when(F.size(own) > 0, names(own)).when(F.size(here) == 1, names(here)).otherwise(names(shared))
    return F.struct(status.alias("status"), F.array_join(F.array_sort(entities), ",").alias("entities"))


def resolved(texts: DataFrame, aliases: DataFrame, text: str = "text", market: str = "market") -> DataFrame:
    """The rows of ``texts`` with ``resolution``, (status, entities), by a join with a registry of aliases.

    Texts meet what was found in them by hash, length and market.
    """
    keys = {"__t": F.xxhash64(text), "__l": F.length(text), "__m": F.col(market)}
    each = texts.select(F.col(text).alias("__text"), *(c.alias(k) for k, c in keys.items()))
    hits = dictionary.found(each, "__text", aliases, "alias")
    entity = F.struct("entity", "country", "brand")
    kinds = hits.groupBy(*keys).agg(*(F.collect_set(F.when(F.col("shared") == flag, entity)).alias(name) for name, flag in (("__own", False), ("__shared", True))))
    same = F.lit(True)
    rows = texts.withColumns(keys)
    for k in keys:
        same = same & rows[k].eqNullSafe(kinds[k])
    none = F.array().cast("array<struct<entity: string, country: string, brand: string>>")
    both = rows.join(kinds, same, "left").select(*(rows[c] for c in texts.columns), *(F.coalesce(kinds[c], none).alias(c) for c in ("__own", "__shared")))
    return both.withColumn("resolution", decided(F.col("__own"), F.col("__shared"), F.col(text), F.col(market))).drop("__own", "__shared")


def registry_names(spark: SparkSession) -> DataFrame:
    """(alias, marker, name, other): how competitors are named, and what marks a company that is taken for one of them."""
    own = [(alias, False, name, None) for name, aliases in T.COMPETITORS for alias in aliases]
    return spark.createDataFrame(own + [(mark, True, name, other) for name, other, marks in T.CONFUSABLES for mark in marks], "alias string, marker boolean, name string, other string")


def resolution(text: Column, market: Column) -> Column:
    """The same for one column of texts and the fixed registry, by a pattern an alias; a plain form to compare with."""
    entity = lambda e: F.struct(F.lit(e[0]).alias("entity"), F.lit(e[2]).alias("country"), F.lit(T.family(e[3])).alias("brand"))
    found = lambda at: F.array_compact(F.array(*(F.when(says(text, e[at]), entity(e)) for e in T.ENTITIES if e[at])))
    return decided(found(4), found(5), text, market)


def bare(text: Column) -> Column:
    """Lower case without diacritics, single spaces."""
    from .rules import folded

    return F.trim(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"\s+", " "))


def publication_findings(c: str = "") -> Column:
    """The failure codes of an insight, in the order of the checks.

    Reads: department, audience, owner, externals, questions, theme, event_type, cited, resolved,
    events, sources, action, trend, future, deadline, effective, as_of, first, last, published,
    models, pipelines.
    """
    none = lambda name: F.size(F.coalesce(F.col(name), F.array())) == 0
    has = lambda text, terms: F.coalesce(sum((text.contains(t).cast("int") for t in terms), F.lit(0)) > 0, F.lit(False))
    action, owner = bare(F.col("action")), bare(F.col("owner"))
    padded = F.concat(F.lit(" "), action, F.lit(" "))
    external = F.exists(F.transform("externals", bare), lambda e: (e != "") & ((owner == e) | (padded.contains(e) & has(padded, T.DIRECTIVES))))
    allowed = F.lit(False)
    for theme, kinds in T.THEME_EVENTS.items():
        allowed = allowed | ((F.upper(F.trim("theme")) == theme) & F.upper(F.trim("event_type")).isin(*kinds))
    late = lambda day: F.col("future") & F.coalesce(F.col(day) < F.col("as_of"), F.lit(False))
    stale = none("published") | F.exists("published", lambda d: d.isNull() | (d < F.col("first")) | (d > F.col("last")))
    mixed = lambda name: (F.size(name) != 1) | has(bare(F.element_at(name, 1)), ("legacy", "unknown", "gpt-4o-mini"))
    checks = (
        ("NO_CITATIONS", none("cited")),
        ("UNRESOLVED_EVIDENCE", ~none("cited") & (F.size(F.array_except("cited", "resolved")) > 0)),
        ("WRONG_DEPARTMENT_AUDIENCE", (F.upper("department") != "PRODUCT") | ~F.upper("audience").isin("PRODUCT", "OUR_COMPANY", "INTERNAL_PRODUCT")),
        ("EXTERNAL_ENTITY_AS_ACTION_OWNER", external),
        ("CHAPTER_CATEGORY_CONTAMINATION", ~F.coalesce(allowed, F.lit(False))),
        ("ACTION_DEADLINE_PASSED", late("deadline")),
        ("EFFECTIVE_DATE_PASSED", late("effective")),
        ("MISSING_PRODUCT_KIQ", ~F.exists("questions", lambda q: F.upper(F.trim(q)).isin(*T.PRODUCT_QUESTIONS))),
        ("MISSING_EVENT_PROVENANCE", none("events")),
        ("MISSING_SOURCE_PROVENANCE", none("sources")),
        ("TREND_INSUFFICIENT_EVENTS", F.col("trend") & (F.size("events") < 2)),
        ("TREND_INSUFFICIENT_SOURCES", F.col("trend") & (F.size("sources") < 2)),
        ("SINGLE_SOURCE_WATCH", ~F.col("trend") & (F.size("sources") == 1)),
        ("MISSING_ACTION", action == ""),
        ("GENERIC_MONITOR_ACTION", (action != "") & has(action, T.MONITORING) & ~has(action, T.DECIDING)),
        ("STALE_INPUT", stale),
        ("LEGACY_VERSION_MIX", mixed("models") | mixed("pipelines")),
    )
    return F.array_compact(F.array(*(F.when(F.coalesce(found, F.lit(False)), F.lit(code)) for code, found in checks)))


def publication_disposition(findings: Column) -> Column:
    """Rejected by any finding but a single source, which only makes an insight one to watch."""
    return F.when(F.size(F.array_remove(findings, "SINGLE_SOURCE_WATCH")) > 0, "REJECT").when(F.size(findings) > 0, "WATCH").otherwise("DECISION_READY")


def likely_language(text: Column, vietnamese: bool) -> Column:
    """Whether a text is prose of the language: few words of the other, quotations not counted."""
    plain = F.regexp_replace(text, "[\"“][^\"”]{1,240}[\"”]", " ")
    words = F.regexp_extract_all(F.lower(plain), F.lit(r"(\p{L}+(?:-\p{L}+)?)"), 1)
    other = F.size(F.filter(words, lambda w: w.isin(*(T.ENGLISH_WORDS if vietnamese else T.VIETNAMESE_WORDS))))
    marked = plain.rlike("[ăâđêôơưĂÂĐÊÔƠƯà-ỹÀ-Ỹ]") if not vietnamese else F.lit(False)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", False).otherwise((other < 3) & ~(marked & (other >= 1)))
