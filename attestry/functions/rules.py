"""Decision rules as column expressions.  Null means unknown and never passes a test."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..domains import APPROVED, EVIDENCE_CHARS

MANUAL = ("APPROVED", "EDITED_APPROVED", "FORCE_APPROVED")
# Phrases of pages that hold no intelligence.
NOISE_PATHS = ("/health-lifestyle/", "/lifestyle/", "/song-khoe/")
NOISE_TITLES = ("thong bao nghi tet", "thong bao nghi le", "holiday closure notice", "office closure notice")


def any_contains(text: Column, terms) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return F.coalesce(found, F.lit(False))


def _bare_letters() -> tuple[str, str]:
    """Letters whose decomposition is one letter and marks, in lower case, with that letter; and đ."""
    found = {"đ": "d"}
    for c in map(chr, range(0xC0, 0x2000)):
        bare = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M")]
        if len(bare) == 1 and bare[0] != c and c == c.lower():
            found[c] = bare[0]
    return "".join(found), "".join(found.values())


_MARKED, _BARE = _bare_letters()


def folded(text: Column) -> Column:
    """Lower case without any accents, whether they are part of a letter or stand behind it."""
    return F.regexp_replace(F.translate(F.lower(text), _MARKED, _BARE), r"\p{M}", "")


def input_policy(now: str, horizon_days: int) -> Column:
    """Which documents are worth a classification; the first reason that holds counts."""
    at = F.lit(now).cast("timestamp")
    published = F.col("published_at")
    return (
        F.when(F.col("sample"), "SAMPLE_DATA")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "EMPTY_CONTENT")
        .when(~F.col("full_text"), "NEEDS_FULL_TEXT")
        .when(F.col("chars") < EVIDENCE_CHARS, "SHORT_CONTENT")
        .when(published.isNull(), "DATE_UNRESOLVED")
        .when(published > at + F.expr("interval 2 days"), "FUTURE_DATED")
        .when(published < at - F.expr(f"interval {horizon_days} days"), "OUTSIDE_ANALYSIS_HORIZON")
        .when(any_contains(folded(F.col("url")), NOISE_PATHS) | any_contains(folded(F.col("title")), NOISE_TITLES), "NON_INTELLIGENCE_CONTENT")
        .otherwise("ELIGIBLE")
    )


def readiness(duplicate: Column, status: Column) -> Column:
    """Whether a document can go to extraction."""
    return (
        F.when(duplicate, "DUPLICATE")
        .when(F.col("parse_status") != "OK", "PARSE_FAILED")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "EMPTY")
        .when(~F.col("full_text"), "NEEDS_FULL_TEXT")
        .when(F.col("chars") < EVIDENCE_CHARS, "SHORT")
        .when(F.coalesce(status, F.lit("")) != "CONFIRMED", "NOT_CONFIRMED")
        .otherwise("READY")
    )


def within(day: Column, first: str, last: str) -> Column:
    return F.coalesce(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(False))


def window_class(first: str, last: str, horizon_days: int) -> Column:
    """How a dated fact belongs to a report window."""
    end = F.lit(last).cast("date")
    ahead = F.least(*(F.when(F.col(c) > end, F.col(c)) for c in ("effective", "expiry", "forecast")))
    old = F.coalesce(F.col("occurred") < F.lit(first).cast("date"), F.lit(False)) | F.coalesce(F.col("effective") < F.lit(first).cast("date"), F.lit(False))
    return (
        F.when(within(F.col("occurred"), first, last) | within(F.col("effective"), first, last) | within(F.col("expiry"), first, last), "CURRENT_EVENT")
        .when((ahead <= F.date_add(end, max(0, horizon_days))) & (F.col("published") <= end), "UPCOMING_ANNOUNCED_EVENT")
        .when(within(F.col("published"), first, last) & old, "NEW_DISCLOSURE_WITH_HISTORICAL_CONTEXT")
        .when(within(F.col("published"), first, last), "CURRENT_EVENT")
        .otherwise("EXCLUDE")
    )


def temporal_status(as_of: str) -> Column:
    day = F.lit(as_of).cast("date")
    return (
        F.when(F.col("expiry") < F.col("effective"), "INVALID_DATE_RANGE")
        .when(F.col("expiry") < day, "EXPIRED")
        .when((F.col("effective") > day) | (F.col("forecast") > day), "UPCOMING")
        .when(F.coalesce("effective", "occurred", "expiry").isNotNull(), "ACTIVE")
        .otherwise("UNDATED")
    )


def temporal_role() -> Column:
    return (
        F.when(F.col("forecast").isNotNull(), "FORECAST")
        .when(F.col("expiry").isNotNull(), "EXPIRING")
        .when(F.col("effective").isNotNull(), "EFFECTIVE")
        .when(F.col("occurred").isNotNull(), "OCCURRED")
        .when(F.col("published").isNotNull(), "PUBLICATION_ONLY")
        .otherwise("UNDATED")
    )


def age_days(day: Column, as_of: str) -> Column:
    return F.greatest(F.datediff(F.lit(as_of).cast("date"), day), F.lit(0))


def attribution_safe() -> Column:
    return (F.col("entity_status") == "RESOLVED") | ((F.col("entity_status") == "UNRESOLVED") & F.col("company").isNull())


def disposition(verdict: Column, safe: Column, analytical: Column) -> Column:
    """What may be done with a claim, from its gate, its review and its latest verdict."""
    excluded = (F.col("gate_status") != "PASS") | F.col("superseded") | ~F.col("review_status").isin(*APPROVED) | ~safe
    by_hand = (verdict == "NEUTRAL") & F.col("review_status").isin(*MANUAL)
    return (
        F.when(excluded, "EXCLUDE")
        .when(verdict == "ENTAILED", "DECISION_GRADE")
        .when(by_hand & analytical, "REVIEWED_ANALYSIS")
        .when(by_hand, "EDITORIAL_WATCH")
        .otherwise("EXCLUDE")
    )


def steps(value: Column, *limits: tuple[int, int], last: int) -> Column:
    """Points by the first limit that a value doesn't exceed."""
    chain = None
    for limit, points in limits:
        chain = F.when(value <= limit, points) if chain is None else chain.when(value <= limit, points)
    return chain.otherwise(last)


def freshness(age: Column) -> Column:
    return steps(age, (7, 15), (30, 12), (90, 8), (180, 4), last=1)


def corroboration(n_sources: Column) -> Column:
    return steps(n_sources, (0, 0), (1, 5), (2, 11), last=15)


def market_fit(market: Column, target: str) -> Column:
    return F.when(market.isNull(), 5).when(F.upper(F.trim(market)) == target, 15).when(F.upper(F.trim(market)).isin("GLOBAL", "REGIONAL", "MULTI"), 10).otherwise(6)


def band(score: Column) -> Column:
    return F.when(score >= 80, "SURFACE_NOW").when(score >= 60, "PRIORITY").when(score >= 40, "WATCH").otherwise("BACKGROUND")


def https_problem(url: Column) -> Column:
    """Why a URL may not be fetched, or null."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return (
        F.when(F.coalesce(F.trim(url), F.lit("")) == "", "EMPTY")
        .when(F.length(url) > 1000, "TOO_LONG")
        .when(F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("")) != "https", "NOT_HTTPS")
        .when(F.coalesce(host, F.lit("")) == "", "NO_HOST")
        .when(F.try_parse_url(url, F.lit("USERINFO")).isNotNull(), "USER_INFO")
        .when(F.try_parse_url(url, F.lit("REF")).isNotNull(), "FRAGMENT")
        .when(F.regexp_extract(url, r"^https://[^/?#]*:(\d+)", 1).isin("", "443") == F.lit(False), "PORT")
        .when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|^\["), "IP_LITERAL")
    )
