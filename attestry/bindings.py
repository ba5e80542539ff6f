"""The data model's tables as views over the driver's tables, in Spark and in SQL.

Each function reads only the columns it needs.  ``with_tables`` puts the same definitions,
written independently as SQL, in front of an oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .domains import AUTHORITIES, CATEGORIES, FACT_TYPES, PRIMARY, ROUTING, ZONE
from .terms import ENTITIES, THEME_EVENTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: F.Column) -> F.Column:
    """The value at a position of a fixed list."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("code", 4, 9).cast("int")
    base = table(spark, sf_dir, "documents").select(F.col("source").alias("code")).distinct().withColumn("n", n)
    authority = pick([a for a, _ in AUTHORITIES], F.col("n") % 10)
    policy = F.when(F.col("n") % 17 == 0, "ARCHIVE_ONLY").when(F.col("n") % 10 >= 8, "WATCH_ONLY").otherwise("DECISION_ELIGIBLE")
    return base.select(
        "code", "n", authority.alias("authority"), pick([s for _, s in AUTHORITIES], F.col("n") % 10).alias("authority_score"),
        (F.col("n") % 10 < PRIMARY).alias("primary_source"), policy.alias("use_policy"), pick(["VN", "SG", "GLOBAL", None], F.col("n") % 4).alias("market"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    published = F.when(i % 20 != 19, F.timestamp_add("HOUR", (i * 7 % 2160).cast("int"), F.lit("2026-06-01 00:00:00").cast("timestamp")))
    intake = F.when(i % 10 == 6, "BROWSER_RENDER").when(i % 10 == 7, "OPEN_SEARCH").when(i % 10 == 8, "MANUAL_TEXT").when(i % 10 == 9, "FILE_UPLOAD").otherwise("CRAWLED")
    return d.select(
        i.alias("id"), F.col("source").alias("source_code"), "text", "lang", F.substring_index("text", "\n", 1).alias("title"), published.alias("published_at"),
        (i % 9 != 0).alias("full_text"), F.when(i % 50 == 0, "PARSE_ERROR").otherwise("OK").alias("parse_status"), (i % 97 == 0).alias("sample"),
        F.concat(F.lit("https://"), "source", F.lit(".example/doc/"), i).alias("url"), intake.alias("intake"),
    ).withColumns({
        "fetched_at": F.coalesce("published_at", F.lit("2026-07-15 00:00:00").cast("timestamp")) + F.expr("interval 1 hour"),
        "content_hash": F.sha2(F.regexp_replace(F.trim("text"), r"\s+", " "), 256),
        "chars": F.length("text").cast("long"),
        "published": F.to_date(F.from_utc_timestamp("published_at", ZONE)),
    })


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    status = F.when(F.col("toxic") == 1, "NO_LABEL_REVIEW").when(F.col("quality") == 1, "CONFIRMED").otherwise("OUT_OF_SCOPE")
    labels = F.array_sort(F.array_distinct(F.array(pick(CATEGORIES, i % 15), pick(CATEGORIES, i * 7 % 15))))
    return table(spark, sf_dir, "labels").select(i, status.alias("status"), labels.alias("labels"))


def routing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROUTING), "category string, department string")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every long line of a confirmed document stands for an extracted fact."""
    docs = documents(spark, sf_dir).select("id", "text", "published", "source_code", "full_text", "sample")
    confirmed = classifications(spark, sf_dir).where("status = 'CONFIRMED'").select(F.col("doc_id").alias("id"))
    line = F.filter(F.transform(F.split("text", "\n", -1), lambda x, k: F.struct(k.cast("int").alias("line"), x.alias("span"))), lambda x: F.length(x["span"]) >= 80)
    rows = docs.join(confirmed, "id").select("id", "published", "source_code", "full_text", "sample", F.posexplode(line).alias("pos", "x"))
    p, day = F.col("pos"), F.col("published")
    effective = F.when(p % 5 == 1, F.date_add(day, p % 40))
    return rows.select(
        F.concat(F.lit("F-"), F.lpad((F.col("id") * 100_000 + p).cast("string"), 16, "0")).alias("code"), F.col("id").alias("doc_id"), "pos", "x.span",
        "source_code", "full_text", "sample", pick(FACT_TYPES, p % 5).alias("fact_type"), "published",
        F.when(p % 2 == 0, F.date_sub(day, p % 7)).alias("occurred"), effective.alias("effective"),
        F.when(p % 10 == 1, F.date_add(effective, p % 30 - 5)).alias("expiry"), F.when(p % 11 == 0, F.date_add(day, 60)).alias("forecast"),
        F.when(p % 3 == 0, F.concat(F.lit("Company "), F.col("id") % 13)).alias("company"), F.when(p % 3 == 0, "RESOLVED").otherwise("UNRESOLVED").alias("entity_status"),
        F.when(p % 5 == 2, F.concat(F.lit("KPI "), p % 4)).alias("kpi_label"), (p % 4 == 0).alias("highlight"),
    )


#: Made-up statements that stand for headlines, so that rules over words meet what they look for.
STATEMENTS = (
    "Insurer launched a new rider with wider coverage", "Monthly voucher campaign for policyholders", "The plan will withdraw its oldest rider from sale", "Survey of 1,200 respondents on savings",
    "A decree on policy wording takes effect", "Premium income and market share grew 12%", "New self-service claims service in the app", "Benefit of the health policy will increase",
    "Premium will decrease for young families", "Bancassurance partnership expanded to the south", "Policy documents changed for clarity", "Sales fell but risk stays low", "Charity day marks the anniversary",
    "Bank raises deposit rates", "Non-life insurance price falls", "Quiet week", "Bảo hiểm nhúng được triển khai trên kênh số", "Ra mắt sản phẩm bảo hiểm mới với quyền lợi cao", "Thông tư mới về điều khoản hợp đồng",
    "Khuyến mãi lớn trong tháng", "Doanh số khai thác mới tăng 5%", "Trend across the market: online underwriting in use", "Lawful allowances and benefits", "Ngân hàng mở rộng cho vay",
)
ALIASES = tuple(alias for e in ENTITIES for alias in (*e[4], *e[5]))
ACTIONS = (
    "Compare the two riders and decide", "Monitor the market", "", "Example Life should lower its price", "Theo dõi và đánh giá quyền lợi", "Watch competitors", "Validate with ví dụ nhân thọ", "Pilot within 60 days",
)
KINDS = ("PRODUCT_LAUNCH", "REGULATORY_CHANGE", "DISTRIBUTION_CHANGE", "CUSTOMER_NEED_SIGNAL", "COMPETITIVE_PERFORMANCE", "CORPORATE_NEWS")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with a headline and what their document and source say of them."""
    docs = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "parse_status", "lang", F.length(F.trim("text")).alias("text_chars"))
    kinds = classifications(spark, sf_dir).select("doc_id", "status", "labels")
    src = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "authority", "market")
    i = F.col("doc_id") * 5 + F.col("pos")
    rows = facts(spark, sf_dir).withColumn("headline", pick(STATEMENTS, i % len(STATEMENTS)))
    rows = rows.withColumns({"product": F.when(i % 4 == 1, F.concat(F.lit("Plan "), i % 9)), "duplicate": i % 53 == 0})
    return rows.join(docs, "doc_id").join(kinds, "doc_id").join(src, "source_code")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that name no, one or two legal entities, with the market of their source."""
    i = F.col("id")
    name = lambda n: pick(ALIASES, n % len(ALIASES))
    said = F.concat("title", F.lit(" – "), F.when(i % 11 == 0, "").when(i % 5 == 0, F.concat(name(i), F.lit(" and "), name(i * 7 + 3))).otherwise(F.initcap(name(i))))
    src = sources(spark, sf_dir).select(F.col("code").alias("source_code"), "market")
    return documents(spark, sf_dir).join(src, "source_code").select("id", said.alias("text"), "market")


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written insight per order, with what it cites, addresses and proposes."""
    i, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    code = lambda n: F.concat(F.lit("F-"), n)
    both = F.array(code(i % 7), code(i % 7 + 1))
    some = lambda values, n: F.slice(F.array(*map(F.lit, values)), F.lit(1), n.cast("int"))
    return table(spark, sf_dir, "orders").select(
        i.alias("insight_id"), F.when(i % 13 == 0, F.array().cast("array<string>")).otherwise(both).alias("cited"), F.when(i % 17 == 0, F.array(code(i % 7))).otherwise(both).alias("resolved"),
        F.when(i % 19 == 0, "SALES").otherwise("PRODUCT").alias("department"), F.when(i % 23 == 0, "SALES_TEAM").otherwise(pick(["PRODUCT", "OUR_COMPANY", "INTERNAL_PRODUCT"], i % 3)).alias("audience"),
        F.when(i % 29 == 0, "Example Life").otherwise("Product team").alias("owner"), F.array(F.lit("Example Life"), F.lit(" Ví dụ Nhân thọ ")).alias("externals"),
        F.when(i % 31 == 0, F.array(F.lit("OTHER"))).otherwise(F.array(F.lit("p-kiq-01"), F.lit("x"))).alias("questions"), pick(tuple(THEME_EVENTS), i % 5).alias("theme"), pick(KINDS, F.floor(i / 5) % 6).alias("event_type"),
        some(["e1", "e2", "e3"], F.floor(i / 2) % 4).alias("events"), some(["s1", "s2"], F.floor(i / 3) % 3).alias("sources"), pick(ACTIONS, i % 8).alias("action"), (i % 4 == 0).alias("trend"), (i % 3 == 0).alias("future"),
        F.date_add(day, (i % 40).cast("int")).alias("deadline"), F.when(i % 2 == 0, F.date_add(day, (i % 60).cast("int") - 10)).alias("effective"), F.lit("1995-06-01").cast("date").alias("as_of"),
        F.lit("1992-03-01").cast("date").alias("first"), F.lit("1998-06-30").cast("date").alias("last"),
        F.when(i % 37 == 0, F.array().cast("array<date>")).when(i % 41 == 0, F.array(day, F.lit(None).cast("date"))).otherwise(F.array(day)).alias("published"),
        F.when(i % 43 == 0, F.array(F.lit("a"), F.lit("b"))).when(i % 47 == 0, F.array(F.lit("GPT-4o-mini x"))).otherwise(F.array(F.lit("m-1"))).alias("models"), F.array(F.lit("v2")).alias("pipelines"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.create_map(*(F.lit(x) for x in ("1-URGENT", "AUTO_APPROVED", "2-HIGH", "APPROVED", "3-MEDIUM", "EDITED_APPROVED", "4-NOT SPECIFIED", "PENDING_REVIEW", "5-LOW", "REJECTED")))
    return o.select(
        F.col("o_orderkey").cast("long").alias("claim_id"), F.col("o_custkey").cast("long").alias("doc_id"), status[F.col("o_orderpriority")].alias("review_status"),
        F.when(F.col("o_orderstatus") == "P", "FAIL_NUMBER_NOT_IN_EVIDENCE").otherwise("PASS").alias("gate_status"), (F.col("o_orderkey") % 11 == 0).alias("superseded"),
        F.to_date("o_orderdate").alias("created"), F.concat(F.lit("T"), F.col("o_orderkey") % 5).alias("tier"),
    )


def verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("l_returnflag") == "A", "ENTAILED").when(F.col("l_returnflag") == "N", "NEUTRAL").when(F.col("l_partkey") % 23 == 0, "VERIFIER_ERROR").otherwise("CONTRADICTED")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("claim_id"), verdict.alias("verdict"), F.to_date("l_shipdate").alias("created"),
        F.col("l_linenumber").cast("long").alias("t1"), F.col("l_partkey").cast("long").alias("t2"), F.col("l_suppkey").cast("long").alias("t3"),
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 3).alias("sample"), F.col("event_type").alias("label"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.select(F.col("event_id").alias("run_id"), F.col("ts").alias("started"))


def item_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'signup'")
    status = pick(["OK", "SKIPPED", "ERROR"], F.pmod(F.floor("value").cast("long"), F.lit(3)))
    return e.select(F.col("event_id").alias("item_id"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("stage"), F.col("ts").alias("created"), status.alias("status"))


def _case(index: str, values) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {k} THEN {v!r}" if isinstance(v, str) else f"WHEN {k} THEN {'NULL' if v is None else v}" for k, v in enumerate(values)) + " END"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pick(index: str, values) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {k} THEN {_text(v)}" for k, v in enumerate(values)) + " END"


TABLES_SQL = {
    "src": f"""SELECT code, n, {_case('n % 10', [a for a, _ in AUTHORITIES])} AS authority, {_case('n % 10', [s for _, s in AUTHORITIES])} AS authority_score, n % 10 < {PRIMARY} AS primary_source,
      CASE WHEN n % 17 = 0 THEN 'ARCHIVE_ONLY' WHEN n % 10 >= 8 THEN 'WATCH_ONLY' ELSE 'DECISION_ELIGIBLE' END AS use_policy, {_case('n % 4', ['VN', 'SG', 'GLOBAL', None])} AS market
      FROM (SELECT DISTINCT source AS code, CAST(substr(source, 4) AS INT) AS n FROM documents)""",
    "docs": """SELECT *, coalesce(published_at, TIMESTAMP '2026-07-15 00:00:00') + INTERVAL 1 HOUR AS fetched_at, sha256(regexp_replace(trim(text, ' '), '\\s+', ' ', 'g')) AS content_hash,
      CAST(length(text) AS BIGINT) AS chars, CAST(published_at + INTERVAL 7 HOUR AS DATE) AS published
      FROM (SELECT doc_id AS id, source AS source_code, text, lang, split_part(text, chr(10), 1) AS title,
        CASE WHEN doc_id % 20 <> 19 THEN TIMESTAMP '2026-06-01 00:00:00' + to_hours(CAST(doc_id * 7 % 2160 AS INT)) END AS published_at, doc_id % 9 <> 0 AS full_text,
        CASE WHEN doc_id % 50 = 0 THEN 'PARSE_ERROR' ELSE 'OK' END AS parse_status, doc_id % 97 = 0 AS sample, 'https://' || source || '.example/doc/' || doc_id AS url,
        CASE doc_id % 10 WHEN 6 THEN 'BROWSER_RENDER' WHEN 7 THEN 'OPEN_SEARCH' WHEN 8 THEN 'MANUAL_TEXT' WHEN 9 THEN 'FILE_UPLOAD' ELSE 'CRAWLED' END AS intake FROM documents)""",
    "cls": f"""SELECT doc_id, CASE WHEN toxic = 1 THEN 'NO_LABEL_REVIEW' WHEN quality = 1 THEN 'CONFIRMED' ELSE 'OUT_OF_SCOPE' END AS status,
      list_sort(list_distinct([{_case('doc_id % 15', CATEGORIES)}, {_case('doc_id * 7 % 15', CATEGORIES)}])) AS labels FROM labels""",
    "rules": "SELECT * FROM (VALUES " + ", ".join(map(str, ROUTING)) + ") r(category, department)",
    "facts": f"""SELECT 'F-' || lpad(CAST(id * 100000 + pos AS VARCHAR), 16, '0') AS code, id AS doc_id, pos, span, source_code, full_text, sample, {_case('pos % 5', FACT_TYPES)} AS fact_type, published,
      CASE WHEN pos % 2 = 0 THEN published - pos % 7 END AS occurred, effective, CASE WHEN pos % 10 = 1 THEN effective + (pos % 30 - 5) END AS expiry, CASE WHEN pos % 11 = 0 THEN published + 60 END AS forecast,
      CASE WHEN pos % 3 = 0 THEN 'Company ' || id % 13 END AS company, CASE WHEN pos % 3 = 0 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS entity_status,
      CASE WHEN pos % 5 = 2 THEN 'KPI ' || pos % 4 END AS kpi_label, pos % 4 = 0 AS highlight
      FROM (SELECT *, CASE WHEN pos % 5 = 1 THEN published + pos % 40 END AS effective FROM (
        SELECT id, span, source_code, full_text, sample, published, CAST(row_number() OVER (PARTITION BY id ORDER BY line) - 1 AS INT) AS pos
        FROM (SELECT d.*, unnest(string_split(text, chr(10))) AS span, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM docs d JOIN cls ON doc_id = id WHERE status = 'CONFIRMED')
        WHERE length(span) >= 80))""",
    "said": f"""SELECT f.*, {_pick(f'(f.doc_id * 5 + pos) % {len(STATEMENTS)}', STATEMENTS)} AS headline, CASE WHEN (f.doc_id * 5 + pos) % 4 = 1 THEN 'Plan ' || (f.doc_id * 5 + pos) % 9 END AS product,
      (f.doc_id * 5 + pos) % 53 = 0 AS duplicate, d.parse_status, d.lang, length(trim(d.text, ' ')) AS text_chars, c.status, c.labels, s.authority, s.market
      FROM facts f JOIN docs d ON d.id = f.doc_id JOIN cls c ON c.doc_id = f.doc_id JOIN src s ON s.code = f.source_code""",
    "mentions": f"""SELECT id, title || ' – ' || CASE WHEN id % 11 = 0 THEN '' WHEN id % 5 = 0 THEN {_pick(f'id % {len(ALIASES)}', ALIASES)} || ' and ' || {_pick(f'(id * 7 + 3) % {len(ALIASES)}', ALIASES)}
      ELSE {_pick(f'id % {len(ALIASES)}', ALIASES)} END AS text, market FROM docs JOIN src ON code = source_code""",
    "insights": f"""SELECT *, d + CAST(i % 40 AS INT) AS deadline, CASE WHEN i % 2 = 0 THEN d + CAST(i % 60 AS INT) - 10 END AS effective FROM (SELECT o_orderkey AS i, o_orderkey AS insight_id, CAST(o_orderdate AS DATE) AS d,
      CASE WHEN o_orderkey % 13 = 0 THEN [] ELSE ['F-' || o_orderkey % 7, 'F-' || (o_orderkey % 7 + 1)] END AS cited,
      CASE WHEN o_orderkey % 17 = 0 THEN ['F-' || o_orderkey % 7] ELSE ['F-' || o_orderkey % 7, 'F-' || (o_orderkey % 7 + 1)] END AS resolved,
      CASE WHEN o_orderkey % 19 = 0 THEN 'SALES' ELSE 'PRODUCT' END AS department, CASE WHEN o_orderkey % 23 = 0 THEN 'SALES_TEAM' ELSE {_pick('o_orderkey % 3', ['PRODUCT', 'OUR_COMPANY', 'INTERNAL_PRODUCT'])} END AS audience,
      CASE WHEN o_orderkey % 29 = 0 THEN 'example life' ELSE 'product team' END AS owner, CASE WHEN o_orderkey % 31 = 0 THEN 'OTHER' ELSE 'P-KIQ-01' END AS question,
      {_pick('o_orderkey % 5', tuple(THEME_EVENTS))} AS theme, {_pick('(o_orderkey // 5) % 6', KINDS)} AS event_type, (o_orderkey // 2) % 4 AS n_events, (o_orderkey // 3) % 3 AS n_sources,
      {_pick('o_orderkey % 8', ACTIONS)} AS action, o_orderkey % 4 = 0 AS trend, o_orderkey % 3 = 0 AS future FROM orders)""",
    "claims": """SELECT CAST(o_orderkey AS BIGINT) AS claim_id, CAST(o_custkey AS BIGINT) AS doc_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'AUTO_APPROVED' WHEN '2-HIGH' THEN 'APPROVED' WHEN '3-MEDIUM' THEN 'EDITED_APPROVED'
      WHEN '4-NOT SPECIFIED' THEN 'PENDING_REVIEW' WHEN '5-LOW' THEN 'REJECTED' END AS review_status, CASE WHEN o_orderstatus = 'P' THEN 'FAIL_NUMBER_NOT_IN_EVIDENCE' ELSE 'PASS' END AS gate_status,
      o_orderkey % 11 = 0 AS superseded, CAST(o_orderdate AS DATE) AS created, 'T' || o_orderkey % 5 AS tier FROM orders""",
    "checks": """SELECT CAST(l_orderkey AS BIGINT) AS claim_id, CASE WHEN l_returnflag = 'A' THEN 'ENTAILED' WHEN l_returnflag = 'N' THEN 'NEUTRAL' WHEN l_partkey % 23 = 0 THEN 'VERIFIER_ERROR' ELSE 'CONTRADICTED' END AS verdict,
      CAST(l_shipdate AS DATE) AS created, l_linenumber AS t1, l_partkey AS t2, l_suppkey AS t3 FROM lineitem""",
    "latest": """SELECT claim_id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY created DESC, t1 DESC, t2 DESC, t3 DESC) AS rn FROM checks) WHERE rn = 1""",
    "votes": "SELECT user_id AS doc_id, event_id % 3 AS sample, event_type AS label FROM events",
    "runs": "SELECT event_id AS run_id, ts AS started FROM events WHERE event_type = 'signup'",
    "items": """SELECT event_id AS item_id, user_id AS doc_id, event_type AS stage, ts AS created, CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'SKIPPED' WHEN 2 THEN 'ERROR' END AS status FROM events WHERE event_type <> 'signup'""",
}
_NEEDS = {"facts": ("docs", "cls"), "latest": ("checks",), "said": ("src", "docs", "cls", "facts"), "mentions": ("docs", "src")}


def with_tables(names: str, body: str) -> str:
    """``body`` behind the definitions of some tables, and of those that they need."""
    wanted: list[str] = []
    for name in names.split():
        for one in (*_NEEDS.get(name, ()), name):
            if one not in wanted:
                wanted.append(one)
    return "WITH " + ",\n".join(f"{name} AS ({TABLES_SQL[name]})" for name in wanted) + (", " if body.lstrip().startswith("also ") else "\n") + body.lstrip().removeprefix("also ")
