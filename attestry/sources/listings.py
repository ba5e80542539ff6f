"""Listings of sites by selectors: pages become a table of elements, and sites' specs a table to join it with.

``tags`` cuts pages into tags and texts in order.  ``elements`` finds where each element ends:
running sums per page and tag name give every tag a level, and an opening tag ends at the next
closing tag of its name and level.  A spec names, for one kind of listing, the item and within
it the title, the link and the day; all specs are joined with all elements in one plan, so more
sites are more rows, not more code.

A selector is a path of up to two steps, each a tag name, a class or both: ``h2.head a.link``.

Defined cases: an element that is never closed ends with its page; a closing tag without an
open element of its name is no tag; void elements (``br``, ``img``) and those closed in place
have no content; comments, scripts and styles are no part of a page; of nested items each is
an item; of items with one link the first counts, and items without title or link are left out;
a null page has no items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import kept
from .web import plain, without_elements

# Elements of HTML that have no content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

#: How some sites mark up their listings, as (listing, item, title, link, day, attribute of the day).
SITE_SPECS = (
    ("AIA_NOTICES", ".cmp-accordion__item", ".cmp-accordion__header span", ".cmp-accordion__body a", None, None),
    ("VIR_INSURANCE", "div.article", ".article-title a.article-link", ".article-title a.article-link", "span.article-date", None),
    ("TNCK_VN", "article.story", ".story__heading a", ".story__heading a", "time", "datetime"),
    ("BIZHUB_INSURANCE", ".vnn-small-news", "h3.meta-data-tit a", "h3.meta-data-tit a", "time.meta-data-source", None),
    ("VIETNAMNET_LIFE", ".horizontalPost__main-title", "a", "a", None, None),
    ("MVI_LIFE", "a.cmp-content-teaser__link", "", "", None, None),
)
ROLES = ("item", "title", "link", "day")


def attribute(tag: Column, name: str) -> Column:
    found = lambda k: F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", k)
    return F.concat(found(1), found(2), found(3))


def tags(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, token, kind, name): the tags and texts of each page in order."""
    bare = without_elements(F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", " "), ("script", "style"))
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(bare, F.lit(r"(?s)<[^<>]*>|[^<]+|<"), 0)).alias("pos", "token"))
    rows = rows.withColumn("name", F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1)))
    kind = (
        F.when(~F.startswith("token", F.lit("<")) | (F.col("token") == "<"), "text").when(F.col("name") == "", "other").when(F.startswith("token", F.lit("</")), "close")
        .when(F.col("name").isin(*VOID) | F.endswith("token", F.lit("/>")), "void").otherwise("open")
    )
    return rows.withColumn("kind", kind)


def elements(events: DataFrame, key: str) -> DataFrame:
    """(key, pos, last, name, token): every element with its first and last position."""
    named = Window.partitionBy(key, "name").orderBy("pos")
    steps = events.where("kind in ('open', 'close')").withColumn("sum", F.sum(F.when(F.col("kind") == "open", 1).otherwise(-1)).over(named))
    low = lambda end: F.least(F.lit(0), F.min("sum").over(named.rowsBetween(Window.unboundedPreceding, end)))
    steps = steps.withColumns({"low": low(0), "before": F.coalesce(low(-1), F.lit(0))}).where("kind = 'open' or sum >= before")
    level = F.col("sum") - F.col("low") + F.when(F.col("kind") == "close", 1).otherwise(0)
    leveled = steps.withColumn("level", level)
    close = F.lead("pos").over(Window.partitionBy(key, "name", "level").orderBy("pos"))
    ends = events.groupBy(key).agg(F.max("pos").alias("end"))
    opened = leveled.withColumn("close", close).where("kind = 'open'").join(ends, key)
    whole = opened.select(key, "pos", F.coalesce("close", "end").alias("last"), "name", "token")
    return whole.unionByName(events.where("kind = 'void'").select(key, "pos", F.col("pos").alias("last"), "name", "token"))


def selectors(spark: SparkSession, specs) -> DataFrame:
    """(spec, role, step, steps, look, name, class): one row for each step of each path; ``look`` is what an element must offer."""
    rows = []
    for spec, *paths, _ in specs:
        for role, path in zip(ROLES, paths, strict=True):
            parts = (path or "").split()
            for step, part in enumerate(parts, 1):
                name, _, kind = part.partition(".")
                rows.append((spec, role, step, len(parts), f".{kind}" if kind else name, name or None))
    return spark.createDataFrame(rows, "spec string, role string, step int, steps int, look string, wanted string")


def matches(found: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """(key, spec, role, pos, last, token) of the elements at the end of a path."""
    offers = F.array_distinct(F.array_append(F.transform(F.filter(F.split(attribute(F.col("token"), "class"), r"\s+"), lambda c: c != ""), lambda c: F.concat(F.lit("."), c)), F.col("name")))
    met = found.withColumn("look", F.explode(offers)).join(paths, "look").where("wanted is null or wanted = name")
    last = met.where("step = steps").select(key, "spec", "role", "pos", "last", "token", "steps")
    outer = met.where("step = 1 and steps = 2").select(key, "spec", "role", F.col("pos").alias("from"), F.col("last").alias("to"))
    inside = last.where("steps = 2").join(outer, [key, "spec", "role"]).where("pos > from and pos <= to").drop("from", "to").distinct()
    return last.where("steps = 1").unionByName(inside).drop("steps")


def absolute(link: Column, page: Column) -> Column:
    """A link as seen from the page that holds it."""
    origin, scheme = F.regexp_extract(page, r"^([A-Za-z]+://[^/?#]*)", 1), F.regexp_extract(page, r"^([A-Za-z]+:)//", 1)
    folder = F.regexp_extract(F.regexp_replace(page, r"[?#].*$", ""), r"^([A-Za-z]+://[^/]*(?:/.*)?/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, link)).when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .otherwise(F.concat(F.when(F.length(folder) > F.length(origin), folder).otherwise(F.concat(origin, F.lit("/"))), link))
    )


def items(pages: DataFrame, specs, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, spec, pos, title, link, day): the items of every listing that a page holds.

    A title or link path that is empty stands for the item itself; a spec without a link gives
    the page's own address, so one item a page.  A title is the element's ``title`` attribute,
    else its text; a day is an attribute or a text.
    """
    spark = pages.sparkSession
    events = kept(tags(pages, key, html), "tags")
    found = kept(elements(events, key), "elements")
    met = kept(matches(found, selectors(spark, specs), key), "matches")
    item = met.where("role = 'item'").select(key, "spec", F.col("pos").alias("item"), F.col("last").alias("until"), "token")
    own = [(s[0], role) for s in specs for role, path in zip(ROLES, s[1:5], strict=True) if path == ""]
    itself = item.join(spark.createDataFrame(own or [(None, None)], "spec string, role string"), "spec").select(key, "spec", "role", "item", F.col("item").alias("pos"), F.col("until").alias("last"), "token")
    parts = met.where("role <> 'item'").join(item.drop("token"), [key, "spec"]).where("pos > item and pos <= until").select(key, "spec", "role", "item", "pos", "last", "token")
    first = parts.unionByName(itself).groupBy(key, "spec", "role", "item").agg(F.min(F.struct("pos", "last", "token")).alias("x")).select(key, "spec", "role", "item", "x.*")
    said = events.where("kind = 'text'").select(key, F.col("pos").alias("at"), "token")
    texts = first.drop("token").join(said, key).where("at > pos and at <= last").groupBy(key, "spec", "role", "item").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("t"))
    full = first.join(texts, [key, "spec", "role", "item"], "left").withColumn("text", plain(F.array_join(F.coalesce(F.transform("t", lambda x: x["token"]), F.array()), " ")))
    days = spark.createDataFrame([(s[0], s[5], s[3] is not None) for s in specs], "spec string, attr string, linked boolean")
    day = F.col("text")
    for name in sorted({s[5] for s in specs if s[5]}):
        day = F.when(F.col("attr") == name, attribute(F.col("token"), name)).otherwise(day)
    value = F.when(F.col("role") == "title", F.coalesce(F.nullif(F.trim(attribute(F.col("token"), "title")), F.lit("")), F.col("text"))).when(F.col("role") == "link", attribute(F.col("token"), "href")).otherwise(day)
    by_role = lambda role: F.max(F.when(F.col("role") == role, F.nullif(F.trim("value"), F.lit(""))))
    rows = full.join(days, "spec").withColumn("value", value).groupBy(key, "spec", "item", "linked").agg(*(by_role(r).alias(r) for r in ROLES[1:]))
    placed = rows.join(pages.select(key, F.col(url).alias("__page")), key).withColumn("link", F.when(F.col("linked"), absolute(F.col("link"), F.col("__page"))).otherwise(F.col("__page")))
    sound = placed.where("title is not null and link is not null")
    return sound.groupBy(key, "spec", "link").agg(F.min(F.struct("item", "title", "day")).alias("x")).select(key, "spec", F.col("x.item").alias("pos"), "x.title", "link", "x.day")
