"""Text functions as column expressions; everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..domains import CHUNK_CHARS, CHUNK_OVERLAP


def normal_title(text: Column, digits: str = "Nd") -> Column:
    """Lower case, everything but letters and digits to single spaces; diacritics stay."""
    return F.trim(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{{digits}}}]+", " "))


def word_set(text: Column) -> Column:
    """The distinct words of a normalised text; none for an empty one."""
    return F.filter(F.array_distinct(F.split(text, " ")), lambda w: w != "")


def word_trigrams(text: Column) -> Column:
    """Distinct runs of three words; the words themselves where there are fewer."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    many = F.greatest(F.size(words) - 2, F.lit(0))
    glue = lambda a, b: F.concat_ws(" ", a, b)
    # shifted copies side by side: each copy is made once, not once per word
    runs = F.zip_with(F.zip_with(F.slice(words, F.lit(1), many), F.slice(words, F.lit(2), many), glue), F.slice(words, F.lit(3), many), glue)
    return F.array_distinct(F.when(F.size(words) >= 3, runs).otherwise(words))


def joined_runs(numbers: Column) -> Column:
    """Distinct 64-bit numbers of the runs of three; the numbers themselves where there are fewer."""
    many = F.greatest(F.size(numbers) - 2, F.lit(0))
    glue = lambda a, b: F.xxhash64(a, b)
    runs = F.zip_with(F.zip_with(F.slice(numbers, F.lit(1), many), F.slice(numbers, F.lit(2), many), glue), F.slice(numbers, F.lit(3), many), glue)
    return F.array_distinct(F.when(F.size(numbers) >= 3, runs).otherwise(numbers))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; zero where one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def cut_after(text: Column, most: int) -> Column:
    """At most ``most`` characters, then an ellipsis beyond them."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def cut_within(text: Column, most: int) -> Column:
    """At most ``most`` characters with the ellipsis among them."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def chunk_plan(chars: Column, window: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Spans (number, begin, end) that cover a text; neighbours share ``overlap`` characters."""
    if not 0 <= overlap < window:
        raise ValueError("overlap must be smaller than the window")
    step = window - overlap
    count = F.greatest(F.lit(1), F.ceil((chars - overlap) / step)).cast("int")
    return F.when(
        chars > 0,
        F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda k: F.struct(k.alias("number"), (k * step).cast("long").alias("begin"), F.least(k * step + window, chars).cast("long").alias("end")),
        ),
    )


def thirds(text: Column, most: int, part: int, between: str = "\n…\n") -> Column:
    """A short text whole; of a longer one its head, middle and tail of ``part`` characters."""
    middle = F.floor((F.length(text) - part) / 2).cast("int") + 1
    pieces = F.concat_ws(between, F.substring(text, 1, part), F.substr(text, middle, F.lit(part)), F.right(text, F.lit(part)))
    return F.when(F.length(text) > most, pieces).otherwise(text)


def around(text: Column, span: Column, reach: int = 80) -> Column:
    """(before, span, after, found) of the first place of a span."""
    at = F.instr(text, span)
    begin = F.greatest(at - reach, F.lit(1))
    return F.struct(
        F.when(at > 0, F.substr(text, begin, at - begin)).alias("before"),
        span.alias("span"),
        F.when(at > 0, F.substr(text, at + F.length(span), F.lit(reach))).alias("after"),
        (F.coalesce(at, F.lit(0)) > 0).alias("found"),
    )


def has_word(text: Column, word: str) -> Column:
    """Whether a term stands between characters that are no letters or digits, in any case."""
    escaped = "".join(c if c.isalnum() or c == " " else "\\" + c for c in word)
    return text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}]){escaped}(?![\p{{L}}\p{{N}}])")


def without_fence(text: Column) -> Column:
    """A reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(json)?\s*", ""), r"\s*```$", ""))


def codes(text: Column) -> Column:
    """The non-blank members of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), lambda c: F.trim(c)), lambda c: c != "")


def number_tokens(text: Column) -> Column:
    """Distinct number tokens, a per cent sign kept and separators as written."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)*\s*%?)"), 1), lambda t: F.regexp_replace(t, r"\s+", ""))))


def canonical_numbers(token: Column) -> Column:
    """The readings of a number token: separators as thousands, or the last one as a decimal point."""
    percent = F.when(token.endswith("%"), "%").otherwise("")
    bare = F.regexp_replace(token, "%", "")
    whole = F.regexp_replace(F.regexp_replace(bare, "[.,]", ""), "^0+(?=[0-9])", "")
    point = F.regexp_replace(F.regexp_replace(bare, "[.,](?=[0-9]*[.,])", ""), ",", ".")
    decimal = F.when(point.contains("."), F.regexp_replace(F.regexp_replace(point, "0+$", ""), r"\.$", "")).otherwise(point)
    grouped = bare.rlike(r"^\d{1,3}([.,]\d{3})+$") | ~bare.rlike("[.,]")
    return F.array_distinct(F.array_compact(F.array(F.concat(F.regexp_replace(decimal, "^0+(?=[0-9])", ""), percent), F.when(grouped, F.concat(whole, percent)))))


def date_literals(text: Column) -> Column:
    """Valid dates written as ISO, day/month/year, in Vietnamese or in Chinese."""
    plain = F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{1,2}-\d{1,2})\b"), 1)
    slash = F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}/\d{1,2}/\d{4})\b"), 1)
    viet = F.regexp_extract_all(F.lower(text), F.lit(r"ngày\s+(\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4})"), 1)
    chinese = F.regexp_extract_all(text, F.lit(r"(\d{4}年\d{1,2}月\d{1,2}日)"), 1)
    found = F.concat(
        F.transform(plain, lambda d: F.try_to_date(d, "yyyy-M-d")),
        F.transform(slash, lambda d: F.try_to_date(d, "d/M/yyyy")),
        F.transform(viet, lambda d: F.try_to_date(F.regexp_replace(d, r"\s+(tháng|năm)\s+", "/"), "d/M/yyyy")),
        F.transform(chinese, lambda d: F.try_to_date(F.regexp_replace(F.regexp_replace(d, "[年月]", "-"), "日", ""), "yyyy-M-d")),
    )
    return F.array_sort(F.array_distinct(F.array_compact(found)))


QUOTES = ('"', '"'), ("“", "”"), ("'", "'"), ("‘", "’"), ("«", "»"), ("「", "」"), ("『", "』")


def quoted_names(text: Column) -> Column:
    """Names of 2 to 120 characters between quotes of seven kinds."""
    parts = [F.regexp_extract_all(text, F.lit(f"{a}([^{a}{b}]{{2,120}}){b}"), 1) for a, b in QUOTES]
    return F.array_distinct(F.filter(F.transform(F.concat(*parts), lambda n: F.trim(n)), lambda n: n != ""))


def slug_label(slug: Column) -> Column:
    return F.when(slug.rlike("^[a-z0-9]+([-_][a-z0-9]+)*$"), F.initcap(F.regexp_replace(slug, "[-_]", " "))).otherwise(slug)


def key_of_label(label: Column, most: int = 32) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.upper(label), "[^A-Z0-9]+", "_"), F.lit("_")), 1, most)
