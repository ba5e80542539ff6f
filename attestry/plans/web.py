"""Web sources over the driver's pages, feeds made from documents, and the streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import documents, sources, table, with_tables
from ..sources import connectors, listings as site, web
from ..storage import scratch
from ..streaming import logs as streams, review


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "pages").select("page_id", web.article(F.col("html")).alias("a"))
    return a.select("page_id", "a.title", F.sha2("a.text", 256).alias("text_sha"), F.length("a.text").cast("long").alias("chars"), "a.note")


def card_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(web.links(F.col("html"))).alias("pos", "link"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "link")


FEED_IDS, SITEMAP_IDS = 2000, 500  # ids that one feed or sitemap may hold, so that none grows with the table


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds per source and range of ids, written and read again."""
    sign = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    docs = documents(spark, sf_dir).where("trim(title) <> '' and published_at is not null").select("id", "source_code", F.floor(F.col("id") / FEED_IDS).alias("part"), "title", "url", "published_at")
    item = F.concat(F.lit("<item><title>"), sign(F.col("title")), F.lit("</title><link>"), "url", F.lit("</link><pubDate>"), F.date_format("published_at", "yyyy-MM-dd HH:mm"), F.lit("</pubDate></item>"))
    feeds = docs.groupBy("source_code", "part").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", item.alias("x")))), lambda r: r["x"]), ""), F.lit("</channel></rss>")).alias("xml"))
    return web.feed_items(feeds, "xml").select("source_code", "part", F.col("pos").cast("long").alias("pos"), "link", "published")


def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / SITEMAP_IDS).alias("part"), F.replace("url", F.lit("&"), F.lit("&amp;")).alias("u"))
    maps = urls.groupBy("part").agg(F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.collect_list("u"), lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))), ""), F.lit("</urlset>")).alias("xml"))
    return web.sitemap_urls(maps, "xml", "/en/").select("link")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(F.struct(F.col("id").alias("id"), F.col("title").alias("title")), F.struct(F.lit(None).cast("long").alias("id"), F.lit("x").alias("title")))
    made = documents(spark, sf_dir).select("id", "title").select(F.to_json(F.struct(rows.alias("data"))).alias("body"))
    return made.select(F.explode(web.listing_rows(F.col("body"))).alias("r")).select("r.id", F.concat_ws("/", F.lit("https://api.example"), F.col("r.id").cast("string")).alias("url"))


def dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents through the reader of its type: items by source, and what could not be read.

    Sources of the home market publish feeds, those of Singapore JSON listings, global ones
    sitemaps; the files are written a document a line, with a broken line for each document
    that failed to parse.
    """
    connectors.register(spark)
    sign = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    kind = F.when(F.col("market") == "VN", "RSS").when(F.col("market") == "SG", "JSON").when(F.col("market") == "GLOBAL", "SITEMAP")
    src = sources(spark, sf_dir).select(F.col("code").alias("source_code"), kind.alias("kind")).where("kind is not null")
    docs = documents(spark, sf_dir).select("id", "source_code", "parse_status", "title", "url").join(src, "source_code")
    tag = lambda name, inner: F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))
    writers = {
        "RSS": tag("rss", tag("item", F.concat(tag("title", sign(F.col("title"))), tag("link", F.col("url"))))), "SITEMAP": tag("urlset", tag("url", tag("loc", F.col("url")))),
        "JSON": F.to_json(F.struct(F.array(F.struct("id", "title", "url")).alias("data"))),
    }
    found = None
    for name, source in connectors.BY_TYPE.items():
        folder = scratch(spark, f"files-{name.lower()}")
        line = F.when(F.col("parse_status") == "OK", writers[name]).otherwise(F.substr(writers[name], F.lit(1), F.length(writers[name]) - 3))
        docs.where(F.col("kind") == name).select(line.alias("value")).where("value is not null").write.text(folder)
        rows = spark.read.format(source.name()).load(folder).select(F.lit(name).alias("kind"), F.regexp_extract("link", r"^https://([^.]+)\.", 1).alias("source_code"), "problem")
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("kind", "source_code", F.coalesce("problem", F.lit("OK")).alias("outcome")).agg(F.count("*").alias("n"))


#: Listings that the driver's pages hold: item, title, link.
PAGE_SPECS = (
    ("MENU", "nav li", "a", "a", None, None), ("MENU_HEAD", "nav", "a", "a", None, None), ("STORY", "article", "h1", None, None, None), ("AD", "div.ad", "", None, None, None),
    ("PAGE", "html", "title", "nav a", None, None), ("FOOT", "footer", "", None, None, None),
)


def site_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of six kinds of listings, found on all pages in one plan."""
    found = site.items(table(spark, sf_dir, "pages").where("page_id is not null"), PAGE_SPECS)
    return found.select("page_id", "spec", "title", "link")


QUERIES = {
    "a04_dispatch": dispatched, "a12_site_listings": site_listings, "a08_article_text": articles, "a13_card_links": card_links, "a05_feed_items": feed, "a06_sitemap_urls": sitemap, "a14_json_listing": listings,
    "j01_stream_ingest": streams.ingested, "j03_stream_windows": streams.counted, "j06_stream_alert_once": streams.alerted, "j05_review_states": streams.decided,
    "j05_claim_states": review.reviewed,
}


def _plain(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'gs')"
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{sign}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' ')"


def _cut(x: str) -> str:
    for name in web.BOILERPLATE:
        x = f"regexp_replace({x}, '<{name}\\b[^>]*>.*?</{name}>', ' ', 'gis')"
    return x


ORACLE_SQL = {
    "a04_dispatch": with_tables("docs src", """SELECT kind, CASE WHEN parse_status = 'OK' THEN source_code END AS source_code, CASE WHEN parse_status = 'OK' THEN 'OK' ELSE 'PARSE_ERROR' END AS outcome, count(*) AS n
      FROM (SELECT *, CASE market WHEN 'VN' THEN 'RSS' WHEN 'SG' THEN 'JSON' WHEN 'GLOBAL' THEN 'SITEMAP' END AS kind FROM docs JOIN src ON code = source_code)
      WHERE kind IS NOT NULL AND NOT (kind = 'JSON' AND parse_status = 'OK' AND trim(title) = '') AND title IS NOT NULL GROUP BY ALL"""),
    "a12_site_listings": f"""WITH c AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<script\\b[^>]*>.*?</script>', ' ', 'gis'), '<style\\b[^>]*>.*?</style>', ' ', 'gis') AS h FROM pages),
      nav AS (SELECT page_id, origin, unnest(regexp_extract_all(n, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(n, '<a href="[^"]*">([^<]*)</a>', 1)) AS said, generate_subscripts(regexp_extract_all(n, '<a href="([^"]*)">', 1), 1) AS k FROM (SELECT *, regexp_extract(h, '(?s)<nav>(.*?)</nav>', 1) AS n FROM c)),
      menu AS (SELECT page_id, origin || href AS link, {_plain('said')} AS title, k FROM nav),
      found AS (SELECT page_id, 'MENU' AS spec, arg_min(title, k) AS title, link FROM menu GROUP BY page_id, link UNION ALL SELECT page_id, 'MENU_HEAD', title, link FROM menu WHERE k = 1
        UNION ALL SELECT page_id, 'STORY', {_plain("regexp_extract(h, '(?s)<article>.*?<h1>(.*?)</h1>', 1)")}, url FROM c UNION ALL SELECT page_id, 'AD', {_plain("regexp_extract(h, '(?s)<div class=\"ad\">(.*?)</div>', 1)")}, url FROM c
        UNION ALL SELECT c.page_id, 'PAGE', {_plain("regexp_extract(h, '(?s)<title>(.*?)</title>', 1)")}, link FROM c JOIN menu ON c.page_id = menu.page_id AND k = 1 UNION ALL SELECT page_id, 'FOOT', {_plain("regexp_extract(h, '(?s)<footer>(.*?)</footer>', 1)")}, url FROM c)
      SELECT page_id, spec, title, link FROM found WHERE title <> '' AND link IS NOT NULL""",
    "a08_article_text": f"""SELECT page_id, title, sha256(t) AS text_sha, CAST(length(t) AS BIGINT) AS chars, note FROM (SELECT page_id, title, CASE WHEN length(i) >= 400 THEN i ELSE w END AS t, CASE WHEN length(i) >= 400 THEN 'ARTICLE' ELSE 'BODY' END AS note
      FROM (SELECT page_id, {_plain("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")} AS title, {_plain(_cut("regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1)"))} AS i, {_plain(_cut("regexp_extract(html, '(?is)<body\\b[^>]*>(.*)</body>', 1)"))} AS w FROM pages))""",
    "a13_card_links": """SELECT page_id, CAST(generate_subscripts(x, 1) - 1 AS BIGINT) AS pos, unnest(x) AS link FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref="([^"]*)"', 1) AS x FROM pages) WHERE len(x) > 0""",
    "a05_feed_items": with_tables("docs", "SELECT source_code, id // 2000 AS part, row_number() OVER (PARTITION BY source_code, id // 2000 ORDER BY id) - 1 AS pos, url AS link, strftime(published_at, '%Y-%m-%d %H:%M') AS published FROM docs WHERE trim(title, ' ') <> '' AND published_at IS NOT NULL"),
    "a06_sitemap_urls": "SELECT DISTINCT regexp_replace(url, '^http://', 'https://') AS link FROM pages WHERE contains(url, '/en/')",
    "a14_json_listing": with_tables("docs", "SELECT id, 'https://api.example/' || id AS url FROM docs WHERE trim(title, ' ') <> ''"),
    "j01_stream_ingest": with_tables("docs", "SELECT min(id) AS id, content_hash FROM docs GROUP BY content_hash"),
    "j06_stream_alert_once": "SELECT DISTINCT user_id FROM events WHERE event_type = 'error'",
    "j05_review_states": "SELECT user_id, CASE arg_min(event_type, (ts, event_id)) WHEN 'purchase' THEN 'APPROVED' ELSE 'REJECTED' END AS state FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id",
    "j05_claim_states": with_tables("checks", """SELECT o_orderkey AS claim_id, CASE WHEN first IS NULL THEN CASE WHEN o_orderdate + INTERVAL 90 DAY < until - INTERVAL 30 DAY THEN 'EXPIRED' ELSE 'PENDING_VERIFICATION' END WHEN first > o_orderdate + INTERVAL 90 DAY THEN 'EXPIRED'
      WHEN verdict = 'ENTAILED' THEN 'AUTO_APPROVED' ELSE 'PENDING_REVIEW' END AS status FROM orders LEFT JOIN (SELECT claim_id, min(created) AS first, arg_max(verdict, (created, t1, t2, t3)) AS verdict FROM checks GROUP BY claim_id) ON claim_id = o_orderkey,
      (SELECT greatest((SELECT max(created) FROM checks), (SELECT max(o_orderdate) FROM orders)) AS until)"""),
    "j03_stream_windows": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM events) GROUP BY ALL",
}
