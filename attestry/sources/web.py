"""Web formats as column expressions: HTML pages, feeds, sitemaps, link lists, JSON listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that never belong to an article, and the least length of one.
BOILERPLATE = ("script", "style", "nav", "footer", "header", "aside", "form")
LEAST_ARTICLE = 400


def without_element(html: Column, name: str) -> Column:
    """Each piece before a closing tag is cut at its first opening tag: linear, also where a page
    opens many elements and closes none."""
    cut = lambda piece: F.regexp_replace(piece, rf"(?is)<{name}\b[^>]*>.*$", "")
    joined = lambda pieces: F.concat_ws(" ", F.array_append(F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), cut), F.element_at(pieces, -1)))
    # the pieces are bound once, else every name would double the expression
    return F.element_at(F.transform(F.array(F.split(html, f"(?i)</{name}>", -1)), joined), 1)


def without_elements(html: Column, names=BOILERPLATE) -> Column:
    for name in names:
        html = without_element(html, name)
    return html


def plain(html: Column) -> Column:
    """Text between tags, common entities resolved, white space collapsed."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def article(html: Column) -> Column:
    """(title, text, note): the article element where it is long enough, else the whole body."""
    inside = plain(without_elements(F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article>", 1)))
    whole = plain(without_elements(F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*)</body>", 1)))
    long_enough = F.length(inside) >= LEAST_ARTICLE
    return F.struct(
        plain(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)).alias("title"),
        F.when(long_enough, inside).otherwise(whole).alias("text"),
        F.when(long_enough, "ARTICLE").otherwise("BODY").alias("note"),
    )


def links(html: Column) -> Column:
    """The targets of all anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), 1)


def feed_items(feeds: DataFrame, xml: str) -> DataFrame:
    """Items of RSS feeds: position, title, link, publication text."""
    fields = [F.xpath(F.col(xml), F.lit(f"//item/{f}/text()")).alias(f) for f in ("title", "link", "pubDate")]
    zipped = feeds.select(*[c for c in feeds.columns if c != xml], F.arrays_zip(*fields).alias("items"))
    return zipped.select(*[c for c in feeds.columns if c != xml], F.posexplode("items").alias("pos", "item")).select(
        *[c for c in feeds.columns if c != xml], "pos", "item.title", "item.link", F.col("item.pubDate").alias("published")
    )


def sitemap_urls(maps: DataFrame, xml: str, fragment: str = "") -> DataFrame:
    """Distinct locations of sitemaps, http made https, with a title from the last path part."""
    loc = F.explode(F.xpath(F.col(xml), F.lit("//url/loc/text()")))
    found = maps.select(loc.alias("loc")).select(F.regexp_replace("loc", "^http://", "https://").alias("link"))
    kept = found.where(F.contains("link", F.lit(fragment))).distinct()
    last = F.regexp_extract("link", r"/([^/?#]+)/?([?#].*)?$", 1)
    return kept.select("link", F.initcap(F.regexp_replace(last, "[-_]+", " ")).alias("title"))


def listing_rows(json: Column) -> Column:
    """Rows of a JSON listing that have both an id and a title."""
    rows = F.from_json(json, "data array<struct<id: long, title: string, date: string>>")["data"]
    return F.filter(rows, lambda r: r["id"].isNotNull() & (F.coalesce(F.trim(r["title"]), F.lit("")) != ""))


def pasted_links(text: Column) -> Column:
    """First https URL of each line, closing punctuation cut, each URL once in order of its lines."""
    lines = F.split(text, r"\r?\n")
    urls = F.transform(lines, lambda x: F.regexp_replace(F.regexp_extract(x, r"(https://\S+)", 1), r"[.,;)\]>]+$", ""))
    return F.array_distinct(F.filter(urls, lambda u: u != ""))


# Where a reader's page ends.
READER_ENDS = ("\n### Truy cập nhanh", "\n## Tin liên quan", "\n### Liên hệ", "\nCopyright ©", "\n* * *\n### Sản phẩm")
LEAST_READER = 300


def reader_article(page: Column) -> Column:
    """(title, text, problem) of a page in the markup of a reader: from its first heading to the first end mark."""
    whole = F.replace(page, F.lit("\r\n"), F.lit("\n"))
    named = F.trim(F.regexp_extract(whole, r"(?m)^Title:\s*(.+)$", 1))
    content = F.when(whole.contains("Markdown Content:"), F.substr(whole, F.instr(whole, F.lit("Markdown Content:")) + 17)).otherwise(whole)
    heading = F.regexp_extract(content, r"(?m)^#\s+(.+)$", 1)
    article = F.coalesce(F.nullif(F.regexp_extract(content, r"(?sm)(^#\s+.*)", 1), F.lit("")), content)
    ends = [F.when(article.contains(mark), F.instr(article, F.lit(mark)) - 1) for mark in READER_ENDS]
    text = F.substr(article, F.lit(1), F.least(*ends, F.length(article)))
    for pattern, put in ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s*", ""), (r"(?m)^\s*[-*]\s+", "• "), (r"(?m)^\s*\|?[-: ]{3,}(?:\|[-: ]{3,})+\|?\s*$", ""), (r"\*\*|__", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        text = F.regexp_replace(text, pattern, put)
    return F.struct(F.when(named != "", named).otherwise(F.trim(heading)).alias("title"), text.alias("text"), F.when(F.length(text) < LEAST_READER, "TOO_SHORT").alias("problem"))


def next_data(html: Column) -> Column:
    return F.regexp_extract(html, r'(?is)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)


# What the titles of financial reports say.
REPORTS = ("bao cao tai chinh", "financial statement", "financial report", "statutory report", "ket qua kinh doanh", "bc-kqkd", "bc kqkd", "bc-tc", "bc tc")
NO_REPORTS = ("quy lien ket", "fund report")


def current_financial_report(title: Column, year: int) -> Column:
    """Whether a title names a financial report of this year or the last."""
    from ..functions.rules import any_contains, folded

    t = folded(title)
    years = F.transform(F.regexp_extract_all(t, F.lit(r"(20\d{2})"), 1), lambda y: y.cast("int"))
    named = any_contains(t, REPORTS) | t.rlike(r"\bbctc\b")
    return named & ~any_contains(t, NO_REPORTS) & F.exists(years, lambda y: y.between(year - 1, year))


def metadata(html: Column, url: Column, as_of: str) -> Column:
    """(title, publisher, lang, day): declared values first, then what the page shows."""
    meta = lambda key, name: F.nullif(F.trim(F.regexp_extract(html, rf'(?is)<meta {key}="{name}" content="([^"]*)"', 1)), F.lit(""))
    title = F.coalesce(meta("property", "og:title"), F.nullif(plain(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)), F.lit("")), F.lit("Imported article"))
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    days = [F.try_to_date(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd") for c in (meta("property", "article:published_time"), meta("name", "date"), F.regexp_extract(html, r'(?i)"datePublished"\s*:\s*"([^"]+)"', 1))]
    sound = [F.when(d <= F.date_add(F.lit(as_of).cast("date"), 1), d) for d in days]
    code = F.regexp_extract(html, r'(?i)<html[^>]*\blang="([a-z]{2})', 1)
    vietnamese = F.lower(html).rlike("[ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]")
    lang = F.when(code.isin("vi", "en", "zh", "ko", "ja"), code).when(vietnamese, "vi").otherwise("en")
    return F.struct(title.alias("title"), F.coalesce(meta("property", "og:site_name"), host, F.lit("Imported website")).alias("publisher"), lang.alias("lang"), F.coalesce(*sound).alias("day"))


def transient(failure: Column) -> Column:
    """Connections and time limits may work the next time; names, certificates and protocols do not."""
    return failure.rlike("(?i)timeout|timed out|connection (reset|refused)") & ~failure.rlike("(?i)unknown host|certificate|tls|protocol")


def publisher_url(link: Column) -> Column:
    inner = F.regexp_extract(link, r"[?&]url=([^&]+)", 1)
    return F.when(inner != "", inner).otherwise(link)
