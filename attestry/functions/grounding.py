"""What a statement may claim of its evidence: citations, names, dates and numbers; sources by their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# Phrases in quotation marks that name nothing.
GENERIC_VI = (
    "thủ tục", "quy trình", "quy định", "văn bản", "sản phẩm", "hợp đồng", "chính sách", "thay đổi", "điều chỉnh", "yêu cầu", "biện pháp", "nội dung", "thông tin", "khoản phí",
    "mức phí", "quy tắc", "điều khoản",
)
GENERIC_EN = (
    "procedure", "process", "rule", "regulation", "document", "product", "policy", "change", "adjustment", "requirement", "measure", "content", "information", "fee", "premium", "term", "condition",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def generic_reference(name: Column) -> Column:
    squeezed = F.regexp_replace(F.trim(name), r"\s+", " ")
    return squeezed.rlike(rf"(?iu)^(?:{'|'.join(GENERIC_VI)})\s+(?:này|đó|ấy|trên|dưới)$") | squeezed.rlike(rf"(?iu)^(?:this|that|these|those|the)\s+(?:{'|'.join(GENERIC_EN)})s?$")


def without_dates(claim: Column) -> Column:
    plain = F.regexp_replace(claim, r"\d{4}年\d{1,2}月\d{1,2}日|\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4}", " ")
    return F.regexp_replace(plain, r"(?i)ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}", " ")


def gate(claim: Column, evidence: Column, cited: Column, known: Column) -> Column:
    """The worst failure of a claim: citations first, then names, dates and numbers."""
    names = F.filter(text.quoted_names(claim), lambda n: ~generic_reference(n) & ~F.contains(evidence, n))
    dates = F.array_except(text.date_literals(claim), text.date_literals(evidence))
    readings = F.flatten(F.transform(text.number_tokens(evidence), text.canonical_numbers))
    numbers = F.filter(text.number_tokens(without_dates(claim)), lambda t: ~F.arrays_overlap(text.canonical_numbers(t), readings))
    return (
        F.when(F.size(cited) == 0, "FAIL_NO_CITATION").when(F.size(F.array_except(cited, known)) > 0, "FAIL_UNKNOWN_CITATION").when(F.size(names) > 0, "FAIL_NAME_NOT_IN_EVIDENCE")
        .when(F.size(dates) > 0, "FAIL_DATE_NOT_IN_EVIDENCE").when(F.size(numbers) > 0, "FAIL_NUMBER_NOT_IN_EVIDENCE").otherwise("PASS")
    )


def wide_dates(value: Column) -> Column:
    """Valid dates of a text in any of five spellings, sorted."""
    lower = F.lower(F.coalesce(value, F.lit("")))
    found = lambda pattern: F.regexp_extract_all(lower, F.lit(pattern), 0)
    part = lambda pattern, k: lambda m: F.regexp_extract(m, pattern, k)
    short = F.create_map(*(F.lit(x) for k, m in enumerate(MONTHS) for name in {m, m[:3], *(["sept"] if k == 8 else [])} for x in (name, str(k + 1))))
    iso, dmy = r"(?<!\d)(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)", r"(?<!\d)(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?!\d)"
    viet = r"(?:ngày\s+)?(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
    day_first, month_first = r"(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]+)\s*,?\s*(\d{4})", r"([a-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?\s*,\s*(\d{4})"

    def dates(pattern: str, order: str) -> Column:
        y, m, d = (order.index(c) + 1 for c in "ymd")
        named = pattern in (day_first, month_first)
        month = lambda x: short[part(pattern, m)(x)] if named else part(pattern, m)(x)
        return F.transform(found(pattern), lambda x: F.try_to_date(F.concat_ws("-", part(pattern, y)(x), F.coalesce(month(x), F.lit("0")), part(pattern, d)(x)), "yyyy-M-d"))

    every = F.concat(dates(iso, "ymd"), dates(dmy, "dmy"), dates(viet, "dmy"), dates(day_first, "dmy"), dates(month_first, "mdy"))
    return F.array_sort(F.array_distinct(F.array_compact(every)))


def grounded(given: Column, evidence: Column) -> Column:
    """Whether a date that a model gave stands in the evidence."""
    day = F.when(given.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(given, "yyyy-MM-dd"))
    blank = F.coalesce(F.trim(given), F.lit("")) == ""
    return F.when(blank, "ABSENT").when(day.isNull(), "INVALID_FORMAT").when(F.array_contains(wide_dates(evidence), day), "GROUNDED").otherwise("UNGROUNDED")


def inferred_authority() -> Column:
    """From code ``k``, lower-case ``name`` and ``host``; the first rule that holds counts."""
    k, name, host = F.col("k"), F.col("name"), F.col("host")
    any_of = lambda c, values: c.rlike("|".join(values))
    return (
        F.when(any_of(k, ("FINANCIALS", "STATUTORY")), "STATUTORY_DISCLOSURE")
        .when(k.rlike("^(MOF_|GOV_)") | any_of(name, ("bộ tài chính", "ministry of finance of vietnam", "cục quản lý,? giám sát bảo hiểm")), "REGULATOR")
        .when(k.startswith("IAV_") | any_of(name, ("hiệp hội bảo hiểm việt nam", "insurance association of vietnam")), "INDUSTRY_BODY")
        .when(any_of(name, ("institute", "research")), "SPECIALIST_RESEARCH")
        .when(any_of(name, ("mckinsey", "bcg", "boston consulting")), "PROFESSIONAL_SERVICES")
        .when(k.contains("SOCIAL") | any_of(host, (r"linkedin\.com", r"facebook\.com", r"x\.com")), "SOCIAL_OR_BLOG")
        .otherwise("UNKNOWN")
    )


def inferred_market() -> Column:
    k, name, host = F.col("k"), F.col("name"), F.col("host")
    country = F.regexp_extract(k, "_(CN|JP|TW|HK|KR|SG|ID|MY|PH|TH)$", 1)
    wide = k.contains("GLOBAL") | k.rlike("^(SWISSRE|MUNICHRE|MCKINSEY)") | name.rlike("boston consulting group|bcg|mckinsey|swiss re institute|munich re")
    return F.when(k.contains("_VN") | k.endswith("VN"), "VN").when(wide, "GLOBAL").when(country != "", country).when(host.contains(".vn"), "VN").otherwise("UNKNOWN")
