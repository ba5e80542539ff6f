"""The SQL that the queries of :mod:`parts` are held against, from the rules and not from the plans."""

from __future__ import annotations

from ..bindings import ALIASES, with_tables
from ..domains import AS_OF, CATEGORIES, GATES
from .web import _cut, _plain  # noqa: F401

_OK = "('AUTO_APPROVED', 'APPROVED', 'EDITED_APPROVED', 'FORCE_APPROVED')"
_DAY = f"DATE '{AS_OF}'"
_USABLE = "use_policy <> 'ARCHIVE_ONLY'"
_TOPIC = "CASE fact_type WHEN 'PRODUCT_LAUNCH' THEN 'PRODUCT_OFFER' WHEN 'REGULATION' THEN 'REGULATORY' WHEN 'METRIC' THEN 'FINANCIAL_PERFORMANCE' WHEN 'CORPORATE_ACTION' THEN 'CORPORATE_ACTION' ELSE 'OTHER' END"
_ROLE = "CASE WHEN forecast IS NOT NULL THEN 'FORECAST' WHEN expiry IS NOT NULL THEN 'EXPIRING' WHEN effective IS NOT NULL THEN 'EFFECTIVE' WHEN occurred IS NOT NULL THEN 'OCCURRED' WHEN published IS NOT NULL THEN 'PUBLICATION_ONLY' ELSE 'UNDATED' END"


def _title_words(c: str) -> str:
    return f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' '), ' '), lambda w: w <> ''))"


def _count(name: str, table: str, **counts: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}.{k}' AS measure, count(*) FILTER ({c}) AS n FROM {table}" for k, c in counts.items())


_STRIPPED = "regexp_replace(regexp_replace(html, '<script\\b[^>]*>.*?</script>', ' ', 'gis'), '<style\\b[^>]*>.*?</style>', ' ', 'gis')"

ORACLE_SQL = {
    "a02_sources_in_order": with_tables("src", "SELECT code, row_number() OVER (ORDER BY authority_score DESC, code) - 1 AS place FROM src"),
    "a03_ingest_summary": with_tables("docs src", f"SELECT *, source_code || ' ok=' || ok || CASE WHEN failed > 0 THEN ' failed=' || failed ELSE '' END AS summary FROM (SELECT source_code, count(*) FILTER (parse_status = 'OK') AS ok, count(*) FILTER (parse_status <> 'OK') AS failed FROM docs JOIN src ON code = source_code WHERE {_USABLE} GROUP BY source_code)"),
    "a07_page_text": f"SELECT page_id, sha256(t) AS text_sha, CAST(length(t) AS BIGINT) AS chars FROM (SELECT page_id, {_plain(_STRIPPED)} AS t FROM pages)",
    "a24_with_source": with_tables("docs src", "SELECT coalesce(authority, 'NO_SOURCE') AS authority, count(*) AS n FROM docs LEFT JOIN (SELECT * FROM src WHERE n % 13 <> 5) ON code = source_code GROUP BY ALL"),
    "a26_pasted_list": "SELECT doc_id, CAST(0 AS BIGINT) AS pos, 'https://a.example/' || doc_id || '.pdf' AS link, 'PDF' AS kind FROM documents UNION ALL SELECT doc_id, 1, 'https://b.example/feed/' || doc_id % 7, 'HTML' FROM documents",
    "b03_failure_rows": with_tables("docs", "SELECT id, parse_status, sha256('failed:' || url) AS content_hash, '' AS text FROM docs WHERE parse_status <> 'OK'"),
    "b04_csv_lines": with_tables("docs", """SELECT id, id || ',"' || replace(title, '"', '""') || '","' || source_code || '","' || url || '"' AS line FROM docs"""),
    "b09_logged": with_tables("items", "SELECT stage, status, count(*) AS n FROM (SELECT stage, status FROM items UNION ALL SELECT 'retry', 'OK' FROM items WHERE status = 'ERROR') GROUP BY ALL"),
    "b11_cache_writes": "SELECT sha256('model-a' || chr(10) || conv_id) AS prompt_sha, CAST(turn AS BIGINT) AS sample, CAST(length(text) AS BIGINT) AS reply_chars FROM conversations WHERE role = 'assistant'",
    "b12_rebuilt_windows": with_tables("docs", f"SELECT CAST(days AS INT) AS days, count(*) AS n, min(published) AS oldest FROM docs, (VALUES (7), (30), (90)) v(days) WHERE published BETWEEN {_DAY} - (days - 1) AND {_DAY} GROUP BY days"),
    "c02_synthesis_facts": with_tables("src facts", f"SELECT f.code, doc_id, fact_type FROM facts f JOIN src ON src.code = source_code WHERE {_USABLE} AND NOT sample AND pos % 19 <> 18"),
    "c03_news_candidates": with_tables("src facts", f"SELECT fact_type, count(*) AS n FROM facts f JOIN src ON src.code = source_code WHERE {_USABLE} AND NOT sample AND pos % 19 <> 18 AND full_text GROUP BY ALL"),
    "c04_audited_codes": with_tables("facts", "SELECT code, pos % 19 <> 18 AS active FROM facts WHERE pos % 19 >= 17"),
    "c05_facts_of": with_tables("facts", "SELECT code, doc_id FROM facts WHERE doc_id IN (SELECT doc_id FROM cls WHERE list_contains(labels, 'SALES_DATA'))"),
    "c06_version_events": with_tables("src facts", "SELECT f.code FROM facts f JOIN src ON src.code = source_code WHERE use_policy = 'DECISION_ELIGIBLE' AND pos % 6 <> 5"),
    "c12_planner_content": with_tables("docs src", f"SELECT id FROM docs JOIN src ON code = source_code WHERE {_USABLE} AND NOT sample AND parse_status = 'OK' AND full_text AND trim(text, ' ') <> ''"),
    "c16_submissions": with_tables("docs", f"""SELECT CASE WHEN trim(title, ' ') = '' OR length(trim(title, ' ')) > 300 THEN 'TITLE' WHEN id % 7 = 3 THEN 'ADDRESS' WHEN published > {_DAY} + 1 THEN 'FUTURE' WHEN lower(lang) NOT IN ('en', 'vi', 'zh', 'ko', 'ja') THEN 'LANGUAGE'
      WHEN length(trim(text, ' ')) < 600 THEN 'SHORT' WHEN length(trim(text, ' ')) > 250000 THEN 'LONG' ELSE 'ACCEPTED' END AS problem, count(*) AS n FROM docs GROUP BY ALL"""),
    "c17_valid_codes": with_tables("src", "SELECT code, x AS normal, regexp_full_match(x, '[A-Z][A-Z0-9_]{2,39}') AS valid FROM (SELECT code, upper(CASE n % 4 WHEN 0 THEN code || '-x' WHEN 1 THEN substr(code, 1, 2) ELSE code END) AS x FROM src)"),
    "c18_safe_facts": with_tables("facts", "SELECT entity_status, entity_status = 'RESOLVED' OR (entity_status = 'UNRESOLVED' AND company IS NULL) AS safe, count(*) AS n FROM facts GROUP BY ALL"),
    "c19_display_dates": with_tables("facts", f"SELECT coalesce(occurred, published) AS day, count(*) AS n FROM facts WHERE coalesce(occurred, published) BETWEEN DATE '2026-07-08' AND {_DAY} GROUP BY ALL"),
    "c20_hot_claims": with_tables("claims", f"SELECT claim_id, tier FROM claims WHERE tier IN ('T3', 'T4') AND review_status IN {_OK}"),
    "c21_latest_states": with_tables("claims latest", "SELECT review_status, count(*) FILTER (verdict = 'VERIFIER_ERROR') AS retryable, count(*) FILTER (verdict = 'ENTAILED' AND gate_status = 'PASS') AS publishable, count(*) FILTER (verdict IS DISTINCT FROM 'CONTRADICTED') AS not_contradicted FROM claims LEFT JOIN latest USING (claim_id) GROUP BY ALL"),
    "c22_life_feed": with_tables("docs", "SELECT id, [true, false, true, false, true, false][CAST(id % 6 + 1 AS INT)] AS relevant FROM docs"),
    "c25_fresh_inputs": with_tables("docs", f"SELECT id, CAST({_DAY} - published AS INT) AS age FROM docs WHERE published <= {_DAY} AND published > {_DAY} - 365"),
    "c26_chapters": with_tables("src facts", "SELECT CASE WHEN market = 'SG' THEN 'ABROAD' WHEN fact_type = 'REGULATION' THEN 'VN_RULES' ELSE 'VN_PRODUCTS' END AS chapter, count(*) AS n FROM facts f JOIN src ON src.code = source_code WHERE market IN ('VN', 'SG') AND fact_type IN ('PRODUCT_LAUNCH', 'REGULATION', 'METRIC') GROUP BY ALL"),
    "c27_source_health": with_tables("docs src", "SELECT source_code, any_value(authority_score) AS authority_score, count(*) FILTER (parse_status <> 'OK') AS failed, count(*) AS n FROM docs JOIN src ON code = source_code GROUP BY source_code HAVING failed > 0"),
    "c28_event_views": with_tables("facts", "SELECT f.code, CASE WHEN f.company IS NULL THEN '' ELSE f.company || '|' || f.fact_type END AS key, coalesce(n, 1) AS n, coalesce(n_sources, 1) AS n_sources FROM facts f LEFT JOIN (SELECT company, fact_type, count(*) AS n, count(DISTINCT source_code) AS n_sources FROM facts WHERE company IS NOT NULL GROUP BY ALL) g ON g.company = f.company AND g.fact_type = f.fact_type"),
    "c30_review_queue": with_tables("checks", "SELECT CASE verdict WHEN 'NEUTRAL' THEN 'NEEDS_REVIEW' ELSE verdict END AS v, count(*) AS n, count(DISTINCT claim_id) AS claims FROM checks GROUP BY ALL"),
    "d02_claims_with_sources": with_tables("docs claims", "SELECT coalesce(source_code, 'NONE') AS source_code, count(*) AS n FROM claims LEFT JOIN docs ON id = doc_id GROUP BY ALL"),
    "d03_events_in_full": with_tables("src facts", "SELECT f.code, lang, authority, coalesce(kpi_docs, 0) AS kpi_docs FROM facts f JOIN docs d ON d.id = f.doc_id JOIN src ON src.code = f.source_code LEFT JOIN (SELECT kpi_label AS k, count(DISTINCT doc_id) AS kpi_docs FROM facts WHERE kpi_label IS NOT NULL GROUP BY ALL) ON k = kpi_label"),
    "d04_by_department": with_tables("cls rules", "SELECT doc_id, string_agg(DISTINCT department, ',' ORDER BY department) AS departments FROM (SELECT doc_id, unnest(labels) AS l FROM cls WHERE status = 'CONFIRMED') JOIN rules ON category = l GROUP BY doc_id HAVING bool_or(department = 'SALES')"),
    "d07_first_labels": with_tables("facts", "SELECT labels[1] AS label, count(*) AS n FROM facts JOIN cls USING (doc_id) GROUP BY ALL"),
    "d12_without_sample_claims": with_tables("docs claims checks", "SELECT verdict, count(*) AS n FROM checks WHERE claim_id NOT IN (SELECT claim_id FROM claims JOIN docs ON id = doc_id WHERE sample) GROUP BY ALL"),
    "d13_probes": with_tables("facts claims", "SELECT id, id IN (SELECT doc_id FROM facts) AS has_facts, id IN (SELECT doc_id FROM claims) AS has_claims, count(*) OVER (PARTITION BY content_hash) > 1 AS has_twin FROM docs"),
    "d15_known_versions": with_tables("docs", "SELECT id FROM docs WHERE id % 3 <> 0"),
    "d21_horizon_pairs": with_tables("facts", "SELECT e.code AS expiring, count(*) AS n FROM facts e JOIN facts a ON a.doc_id = e.doc_id AND e.expiry BETWEEN a.effective AND a.effective + 30 GROUP BY ALL"),
    "d25_intake_sources": with_tables("docs", "SELECT id, CASE WHEN id % 3 <> 0 OR id % 2 = 0 THEN source_code ELSE 'NEW:nowhere.example' END AS source_code FROM docs"),
    "e02_retired": with_tables("claims", "SELECT tier, rn = 1 AS current, count(*) AS n FROM (SELECT tier, row_number() OVER (PARTITION BY tier ORDER BY created DESC, claim_id DESC) AS rn FROM claims) GROUP BY ALL"),
    "e03_activated": with_tables("items", "SELECT doc_id, item_id, item_id % 4 AS n_facts FROM items WHERE status = 'OK' AND item_id % 4 > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY created DESC, item_id DESC) = 1"),
    "e05_activation_rule": with_tables("claims", "SELECT gate_status = 'PASS' AND claim_id % 4 >= 1 AS activate, count(*) AS n FROM claims GROUP BY ALL"),
    "e06_edition_keys": with_tables("docs", "SELECT id, sha256('contract-2' || chr(10) || 'model-a' || chr(10) || 'writer' || chr(10) || 'prompt-1') AS signature, sha256(text) AS input_hash FROM docs"),
    "e16_value_ledger": with_tables("facts", "SELECT company, greatest(count(*) FILTER (pos % 2 = 0) - count(*) FILTER (pos < 6), 0) AS added FROM facts WHERE company IS NOT NULL GROUP BY company"),
    "e18_reposted": with_tables("docs", "SELECT lang, url || '#repost' AS url, 'OTHER_PUBLISHER' AS authority, fetched_at - INTERVAL 1 HOUR AS fetched_at, content_hash FROM docs WHERE parse_status = 'OK' QUALIFY row_number() OVER (PARTITION BY lang ORDER BY id DESC) = 1"),
    "e19_forced_retry": with_tables("claims checks", "SELECT verdict, count(*) AS kept FROM checks WHERE claim_id NOT IN (SELECT claim_id FROM claims WHERE gate_status <> 'PASS') GROUP BY ALL"),
    "f11_checkpoint_counts": with_tables("facts claims checks", " UNION ALL ".join((
        _count("documents", "docs", all="true", full_text="full_text", unread="parse_status <> 'OK'", undated="published IS NULL", sample="sample"),
        _count("classifications", "cls", all="true", confirmed="status = 'CONFIRMED'", review="status = 'NO_LABEL_REVIEW'", out="status = 'OUT_OF_SCOPE'"),
        _count("facts", "facts", all="true", highlights="highlight", companies="company IS NOT NULL", metrics="fact_type = 'METRIC'", expiring="expiry IS NOT NULL"),
        _count("claims", "claims", all="true", passed="gate_status = 'PASS'", pending="review_status = 'PENDING_REVIEW'", superseded="superseded"),
        _count("verifications", "checks", all="true", entailed="verdict = 'ENTAILED'", errors="verdict = 'VERIFIER_ERROR'"),
    ))),
    "m24_preflight": with_tables("facts claims", """also d AS (SELECT count(*) AS docs, count(*) FILTER (NOT full_text) AS a, count(*) FILTER (full_text AND chars < 600) AS b, count(*) FILTER (parse_status <> 'OK') AS c, count(*) FILTER (NOT full_text OR chars < 600 OR parse_status <> 'OK') AS bad FROM docs),
      p AS (SELECT count(*) FILTER (review_status = 'PENDING_REVIEW') AS pending FROM claims), f AS (SELECT count(*) AS facts FROM facts)
      SELECT * FROM (VALUES ('PIPELINE_IDLE', 'BLOCKER', true, ''), ('BACKUP_CONFIRMED', 'BLOCKER', true, ''), ('CLASSIFIER_CONFIGURED', 'BLOCKER', true, ''), ('WRITER_CONFIGURED', 'BLOCKER', true, ''), ('VERIFIER_CONFIGURED', 'BLOCKER', false, '')) v(name, severity, passed, detail)
      UNION ALL SELECT 'CONTENT_BACKFILL', 'WARNING', bad = 0, concat_ws('/', a, b, c) FROM d UNION ALL SELECT 'PENDING_REVIEW', 'WARNING', pending = 0, CAST(pending AS VARCHAR) FROM p UNION ALL SELECT 'CORPUS_COUNTS', 'INFO', true, concat_ws('/', docs, facts) FROM d, f"""),
    "f12_inventory": with_tables("docs", "SELECT lang, count(*) AS documents, count(*) FILTER (NOT full_text) AS title_only, count(*) FILTER (full_text AND chars < 600) AS short, count(*) FILTER (parse_status <> 'OK') AS unread FROM docs GROUP BY lang"),
    "f14_subject_pages": with_tables("facts", "SELECT fact_type, company, count(*) AS n FROM facts WHERE company IS NOT NULL GROUP BY ALL HAVING n >= 2"),
    "f18_distinct_counts": with_tables("src facts", "SELECT fact_type, count(DISTINCT source_code) AS sources, count(DISTINCT CASE WHEN primary_source THEN source_code END) AS primary_sources, count(DISTINCT kpi_label) AS topics FROM facts f JOIN src ON src.code = source_code GROUP BY ALL"),
    "f20_drafts": with_tables("src facts", "SELECT company, count(DISTINCT doc_id) AS docs, count(DISTINCT source_code) AS sources, bool_or(primary_source) AS official, CAST(round(avg(authority_score)) AS BIGINT) AS score, bool_and(highlight) AS all_highlights, sha256(arg_min(span, f.code)) AS first_line FROM facts f JOIN src ON src.code = source_code WHERE company IS NOT NULL GROUP BY company"),
    "g03_first_per_url": "SELECT url, min(page_id) AS page_id FROM pages GROUP BY url",
    "g16_ranked_insights": with_tables("facts", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY highlight DESC, code) AS rank, code FROM facts"),
    "g18_key_findings": with_tables("facts", "SELECT doc_id, array_to_string(CASE WHEN len(h) > 0 THEN h ELSE c END[1:3], ',') AS codes FROM (SELECT doc_id, list(code ORDER BY code) FILTER (highlight) AS h, list(code ORDER BY code) AS c FROM facts GROUP BY doc_id)"),
    "h01_ordered_documents": with_tables("docs", "SELECT id, source_code, published FROM docs ORDER BY published DESC NULLS LAST, source_code, id LIMIT 10"),
    "h03_cluster_order": with_tables("facts", "SELECT company, fact_type, count(*) AS n, max(published) AS newest FROM facts GROUP BY ALL ORDER BY n DESC, newest DESC NULLS LAST, company NULLS LAST, fact_type LIMIT 12"),
    "h04_finding_order": with_tables("src facts", "SELECT f.code, authority_score, fact_type, coalesce(company, '') AS subject FROM facts f JOIN src ON src.code = source_code ORDER BY authority_score DESC, fact_type, subject, f.code LIMIT 15"),
    "h05_log_order": with_tables("items", "SELECT item_id, stage, status FROM items ORDER BY created DESC, item_id DESC LIMIT 20"),
    "h06_tier_order": with_tables("claims", "SELECT tier, count(*) AS n, min(claim_id) AS first_id FROM claims WHERE tier IN ('T2', 'T3', 'T4') GROUP BY tier"),
    "h08_clamped": with_tables("docs", "SELECT id, CASE WHEN id % 60 - 10 < 1 THEN 1 WHEN id % 60 - 10 > 25 THEN 25 ELSE id % 60 - 10 END AS size FROM docs"),
    "i02_due_claims": with_tables("claims latest", "SELECT claim_id, CASE WHEN review_status = 'PENDING_REVIEW' THEN 'PENDING' ELSE 'RETRY' END AS why FROM claims LEFT JOIN latest USING (claim_id) WHERE review_status = 'PENDING_REVIEW' OR verdict = 'VERIFIER_ERROR'"),
    "i03_label_sets": with_tables("docs cls", f"""also u AS (SELECT lang, status, unnest(labels) AS l FROM cls JOIN docs ON id = doc_id), h AS (SELECT lang, list(DISTINCT l) AS have, coalesce(list(DISTINCT l) FILTER (status = 'CONFIRMED'), []) AS sure FROM u GROUP BY lang)
      SELECT lang, array_to_string(list_sort(list_filter({list(CATEGORIES)}, lambda x: NOT list_contains(have, x))), ',') AS missing, array_to_string(list_sort(have), ',') AS either, array_to_string(list_sort(sure), ',') AS both, NOT list_contains(sure, 'SALES_DATA') AS disjoint FROM h"""),
    "i06_citation_sets": with_tables("claims", """SELECT claim_id, CAST(len(list_filter(c, lambda x: NOT list_contains(k, x))) AS INT) AS unresolved, len(list_filter(c, lambda x: NOT list_contains(k, x))) = 0 AS within, list_sort(c) = list_sort(k) AS equal, array_to_string(c, ',') AS in_order
      FROM (SELECT claim_id, CASE WHEN claim_id % 5 = claim_id % 7 THEN [claim_id % 5] ELSE [claim_id % 5, claim_id % 7] END AS c, list_distinct([claim_id % 5, claim_id % 3]) AS k FROM claims)"""),
    "i09_missing_buckets": with_tables("facts", "SELECT company, b AS fact_type FROM (SELECT DISTINCT company FROM facts WHERE company IS NOT NULL), (VALUES ('PRODUCT_LAUNCH'), ('REGULATION'), ('METRIC'), ('CORPORATE_ACTION'), ('OTHER'), ('PRICING')) v(b) EXCEPT SELECT company, fact_type FROM facts"),
    "j02_late_pairs": with_tables("docs", "SELECT id, CAST(floor(epoch(coalesce(published_at, fetched_at)) / 259200) AS BIGINT) AS band, CAST(floor(epoch(coalesce(published_at, fetched_at)) / 259200) - 1 AS BIGINT) AS reaches FROM docs"),
    "j04_monthly_keys": with_tables("facts", "SELECT coalesce(strftime(coalesce(occurred, effective, published), '%Y-%m'), 'UNDATED') AS month, count(*) AS n FROM facts GROUP BY ALL"),
    "j08_held_attempts": with_tables("items", "SELECT CASE WHEN status = 'OK' THEN 'DONE' WHEN item_id % 3 <> 0 THEN 'HELD' ELSE 'DUE' END AS state, count(*) AS n FROM (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY created DESC, item_id DESC) = 1) GROUP BY ALL"),
    "j09_saturation": with_tables("facts", "SELECT lang, before, after, CASE WHEN after > before THEN 'NEXT_BATCH' WHEN n >= 20 THEN 'AUDIT' ELSE 'READY' END AS decision FROM (SELECT lang, count(DISTINCT company) FILTER (pos < 6) AS before, count(DISTINCT company) AS after, count(DISTINCT doc_id) AS n FROM facts f JOIN docs d ON d.id = f.doc_id GROUP BY lang)"),
    "j10_recovered_queue": with_tables("items", "SELECT stage, was, CASE was WHEN 'DONE' THEN was ELSE 'FAILED' END AS now, count(*) AS n FROM (SELECT stage, CASE status WHEN 'SKIPPED' THEN 'RUNNING' WHEN 'ERROR' THEN 'QUEUED' ELSE 'DONE' END AS was FROM items) GROUP BY ALL"),
    "j11_single_flight": with_tables("runs", "SELECT rn = 1 AS started, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY date_trunc('hour', started) ORDER BY run_id) AS rn FROM runs) GROUP BY ALL"),
    "k02_entity_keys": with_tables("docs", "SELECT id, sha256(trim(regexp_replace(lower(title || ' ②'), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ')) AS key FROM docs"),
    "k04_gate_statuses": with_tables("claims", "SELECT CASE " + " ".join(f"WHEN claim_id % {p} = 0 THEN '{GATES[k]}'" for k, p in enumerate((17, 13, 11, 7, 5, 3))) + f" ELSE '{GATES[-1]}' END AS status, count(*) AS n FROM claims GROUP BY ALL"),
    "k06_literal_dates": with_tables("facts", """SELECT code, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN pos % 40 BETWEEN 1 AND 31 THEN strftime(make_date(2026, 7, CAST(pos % 40 AS INT)), '%Y-%m-%d') END,
      CASE WHEN pos % 14 BETWEEN 1 AND 12 THEN strftime(make_date(2026, CAST(pos % 14 AS INT), 1), '%Y-%m-%d') END, strftime(make_date(2026, 8, CAST(pos % 31 + 1 AS INT)), '%Y-%m-%d')], lambda x: x IS NOT NULL))), ',') AS dates FROM facts"""),
    "k09_names_in_quotes": with_tables("facts", "SELECT code, 'Plan ' || pos || '|this product|An Tâm' AS names FROM facts"),
    "k10_generic_names": with_tables("facts", "SELECT code, pos % 5 IN (0, 1, 4) AS generic FROM facts"),
    "k11_span_overlap": with_tables("facts", f"""SELECT id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS overlap
      FROM (SELECT d.id, {_title_words('title')} AS a, {_title_words('span')} AS b FROM docs d JOIN facts ON doc_id = d.id WHERE pos = 0)"""),
    "k14_cut_texts": with_tables("docs", "SELECT id, CAST(CASE WHEN chars > 300 THEN 301 ELSE chars END AS INT) AS after, CAST(least(chars, 300) AS INT) AS within FROM docs"),
    "k16_text_hashes": with_tables("docs", "SELECT id, sha256(text) AS plain, sha256(regexp_replace(trim(text, ' '), '\\s+', ' ', 'g')) AS content_hash FROM docs"),
    "k19_dedup_excerpts": with_tables("docs", "SELECT id, md5(CASE WHEN length(text) > 1800 THEN substr(text, 1, 600) || ' … ' || substr(text, CAST(floor((length(text) - 600) / 2) AS BIGINT) + 1, 600) || ' … ' || right(text, 600) ELSE text END) AS excerpt FROM docs"),
    "k26_verdict_words": with_tables("claims", "SELECT CASE claim_id % 6 WHEN 0 THEN 'ENTAILED' WHEN 1 THEN 'CONTRADICTED' WHEN 2 THEN 'NEUTRAL' ELSE 'VERIFIER_ERROR' END AS verdict, count(*) AS n FROM claims GROUP BY ALL"),
    "k28_json_strings": with_tables("docs", "SELECT id, sha256(title || ' \"q\" \\ ' || chr(9)) AS back FROM docs"),
    "k32_url_parts": "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) LIKE '%.example.com' AS same_site FROM pages",
    "k33_search_queries": with_tables("docs", """SELECT id, array_to_string(list_slice(regexp_extract_all(trim(regexp_replace('site:a.example "life insurance" ' || title || ' site:b.example', 'site:\\S+', '', 'g'), ' '), '("[^"]*"|\\S+)', 1), 1, 8), ' ') || ' site:a.example' AS query FROM docs"""),
    "k35_display_texts": with_tables("docs", """SELECT id, trim(regexp_replace(regexp_replace(regexp_replace('year-on-year - ' || regexp_replace(regexp_replace(substr(title, 1, 20), '[‐-―−]', '-', 'g'), '([\\p{L}\\p{N}])#([\\p{L}\\p{N}])', '\\1-\\2', 'g') || ' , up ; (Pattern: two facts)  end .', '\\s*;?\\s*\\(Pattern: two facts\\)\\s*', ' ', 'g'), '\\s+([,.;:])', '\\1', 'g'), '[ \\t]{2,}', ' ', 'g'), ' ') AS shown FROM docs"""),
    "k36_localised": with_tables("docs", """SELECT id, regexp_replace(regexp_replace(regexp_replace('Giới hạn bằng chứng: ' || substr(title, 1, 10) || ' facts, evidence and gates', '(?i)\\bfacts?\\b', 'dữ kiện', 'g'), '(?i)\\bevidence\\b', 'bằng chứng', 'g'), '(?i)\\bgates?\\b', 'cổng kiểm định', 'g') AS shown FROM docs"""),
    "k38_place_names": with_tables("src", "SELECT code, CASE WHEN market = 'VN' THEN 'Vietnam' WHEN market = 'SG' THEN 'Singapore' WHEN market = 'GLOBAL' THEN 'Global' WHEN n % 4 = 0 THEN 'Hong Kong' WHEN n % 4 = 1 THEN 'Japan' WHEN n % 4 = 3 THEN 'South Korea' ELSE 'Regional / international' END AS place FROM src"),
    "k39_date_dimensions": with_tables("facts", """SELECT code, CASE WHEN d <= published THEN d END AS occurred, CASE WHEN d > published AND fact_type = 'REGULATION' THEN d END AS effective, CASE WHEN d > published AND fact_type = 'METRIC' THEN d END AS forecast
      FROM (SELECT code, published, fact_type, coalesce(effective, occurred) AS d FROM facts)"""),
    "k40_local_days": with_tables("docs", f"SELECT id, CAST(fetched_at + INTERVAL 7 HOUR AS DATE) AS day, CAST(CASE WHEN published IS NOT NULL THEN greatest({_DAY} - published, 0) ELSE 0 END AS INT) AS age FROM docs"),
    "k45_story_keys": with_tables("facts", "SELECT doc_id, 'RC:' || substr(sha256(string_agg(code, chr(10) ORDER BY code)), 1, 20) AS story_key, 'ME:' || doc_id || ':' || substr(sha256('v2'), 1, 16) AS event_key FROM facts GROUP BY doc_id"),
    "k48_slugs": with_tables("src", "SELECT code, 'Life Insurance ' || upper(code[1]) || substr(code, 2) AS label FROM src"),
    "k49_split_codes": "SELECT doc_id, 'F-1|F-' || doc_id AS codes FROM labels",
    "k50_sentences": with_tables("docs", "SELECT id, 'F-1,F-' || id AS codes, CASE WHEN id % 3 = 0 THEN 'PRODUCT' END AS bucket FROM docs WHERE id % 4 <> 0 AND trim(title, ' ') <> ''"),
    "k51_numbers_within": with_tables("facts", "SELECT code, pos % 4 IN (2, 3) AS within FROM facts"),
    "k54_routed_fields": with_tables("facts", "SELECT code, CASE pos % 3 WHEN 0 THEN 'METRIC' WHEN 2 THEN 'OTHER' END AS bucket, CASE pos % 4 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' WHEN 3 THEN 'FLAT' END AS trend, pos % 2 = 0 AS value_kept FROM facts"),
    "k55_temporal_roles": with_tables("facts", f"SELECT {_ROLE} AS role, count(*) AS n FROM facts GROUP BY ALL"),
    "k56_fallback_topics": with_tables("facts", f"SELECT CASE WHEN kpi_label IS NOT NULL THEN 'SALES' ELSE {_TOPIC} END AS topic, count(*) AS n FROM facts GROUP BY ALL"),
    "l01_broken_domains": with_tables("cls", "SELECT 'SALES-DATA' AS label, count(*) AS n FROM (SELECT unnest(labels) AS l FROM cls) WHERE l = 'SALES_DATA' HAVING n > 0"),
    "l04_filled_metadata": with_tables("src", "SELECT code, CASE WHEN market IS NOT NULL THEN market WHEN n % 3 = 0 THEN 'VN' ELSE 'UNKNOWN' END AS market, market IS NULL AS inferred FROM src"),
    "l05_upserted_sources": with_tables("src", "SELECT code, CASE WHEN code LIKE 'src1%' THEN 'INDUSTRY_BODY' ELSE authority END AS authority FROM src UNION ALL SELECT 'added', 'UNKNOWN'"),
    "l06_prompts": with_tables("src", "SELECT code, CASE WHEN n % 3 = 0 THEN 'own ' || code ELSE 'default prompt' END AS body FROM src"),
    "l07_broken_keys": with_tables("docs", "SELECT content_hash, count(*) AS n, min(id) AS first_id FROM docs GROUP BY ALL HAVING n > 1"),
    "m02_winners": with_tables("docs src", """also d AS (SELECT id, content_hash, published_at AS p, authority_score AS s FROM docs JOIN src ON code = source_code), f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY id) = 1)
      SELECT f.id AS a, d.id AS b, CASE WHEN d.s > f.s THEN d.id WHEN d.s < f.s THEN f.id WHEN d.p > f.p THEN d.id ELSE f.id END AS winner, d.s = f.s AND NOT coalesce(d.p <> f.p, false) AS flagged FROM d JOIN f USING (content_hash) WHERE d.id <> f.id"""),
    "m15_narrative_inputs": with_tables("claims latest", f"SELECT claim_id, verdict FROM claims JOIN latest USING (claim_id) WHERE gate_status = 'PASS' AND NOT superseded AND review_status IN {_OK} AND verdict <> 'CONTRADICTED'"),
    "m19_owned_actions": with_tables("claims", "SELECT claim_id % 4 IN (0, 3) AS complete, count(*) AS n FROM claims GROUP BY ALL"),
    "m21_themes": with_tables("insights", """SELECT CASE WHEN i % 18 = 0 THEN 'REGIONAL_TRANSFER' WHEN event_type = 'REGULATORY_CHANGE' THEN CASE WHEN i % 2 = 0 THEN 'NONE' ELSE 'VN_REGULATORY_CHANGE' END WHEN event_type = 'PRODUCT_LAUNCH' THEN CASE WHEN i % 2 = 0 THEN 'REGIONAL_TRANSFER' ELSE 'VN_PRODUCT_OFFER' END
      WHEN event_type = 'DISTRIBUTION_CHANGE' THEN CASE WHEN i % 2 = 0 THEN 'REGIONAL_TRANSFER' ELSE 'DISTRIBUTION_INNOVATION' END WHEN event_type = 'CORPORATE_NEWS' THEN 'NONE' ELSE 'MARKET_PATTERN' END AS theme, count(*) AS n FROM insights GROUP BY ALL"""),
    "m22_news_topics": with_tables("docs src cls", """SELECT CASE WHEN list_has_any(labels, ['PRODUCT_REGULATION', 'INDUSTRY_REGULATION']) THEN 'REGULATION' WHEN list_has_any(labels, ['PRODUCT_LAUNCH', 'FEE_BENEFIT_COMMISSION_CHANGE']) THEN 'PRODUCT' WHEN list_contains(labels, 'DISTRIBUTION_CHANNEL') THEN 'DISTRIBUTION'
      WHEN list_has_any(labels, ['SALES_DATA', 'COMPANY_FINANCIAL_PERFORMANCE']) THEN 'PERFORMANCE' ELSE 'OTHER' END AS topic, CASE WHEN market = 'VN' THEN 'VIETNAM' WHEN market IS NULL THEN 'UNKNOWN' ELSE 'INTERNATIONAL' END AS scope, count(*) AS n FROM cls JOIN docs ON id = doc_id JOIN src ON code = source_code GROUP BY ALL"""),
    "m26_enriched": with_tables("src facts", f"SELECT f.code, authority, coalesce(market, 'UNKNOWN') AS market, {_ROLE} AS role, {_TOPIC} AS topic FROM facts f JOIN src ON src.code = source_code"),
    "m28_brief_modes": with_tables("src facts", "SELECT source_code, CASE WHEN count(*) FILTER (highlight) >= 3 AND bool_or(primary_source) THEN 'DECISION' WHEN count(*) FILTER (highlight) >= 1 THEN 'WATCH' ELSE 'NONE' END AS mode FROM facts f JOIN src ON src.code = source_code GROUP BY source_code"),
    "m29_page_plan": with_tables("claims", f"""SELECT tier, CAST(generate_subscripts(p, 1) AS BIGINT) AS number, unnest(p) AS page FROM (SELECT tier, list_filter(['COVER', CASE WHEN count(*) FILTER (review_status IN {_OK}) > 0 THEN 'FINDINGS' END, CASE WHEN count(*) FILTER (superseded) > 1000000 THEN 'HISTORY' END,
      CASE WHEN count(*) FILTER (gate_status <> 'PASS') > 0 THEN 'GAPS' END, 'SOURCES'], lambda x: x IS NOT NULL) AS p FROM claims GROUP BY tier)"""),
    "m30_provider_safety": with_tables("claims", "SELECT m[CAST(claim_id % 4 + 1 AS INT)] AS writer, m[CAST((claim_id // 5) % 4 + 1 AS INT)] AS verifier, claim_id % 4 <> 0 AND (claim_id // 5) % 4 <> 0 AND claim_id % 4 <> (claim_id // 5) % 4 AS allowed, count(*) AS n FROM claims, (SELECT ['stub', 'claude-x', 'gpt-y', 'deepseek-z'] AS m) GROUP BY ALL"),
    "m32_golden_scores": with_tables("claims", "SELECT claim_id, s AS score, CASE WHEN s >= 75 THEN 'PUBLISH' WHEN s >= 55 THEN 'REVIEW' WHEN s >= 35 THEN 'WATCH' ELSE 'DROP' END AS decision FROM (SELECT claim_id, CAST(claim_id % 11 * 10 * 0.5 + claim_id % 7 * 15 * 0.25 + claim_id % 5 * 25 * 0.25 AS DOUBLE) AS s FROM claims)"),
    "m35_unique_citations": with_tables("claims", """SELECT claim_id, array_to_string(list_filter(CASE WHEN claim_id % 4 = claim_id % 3 THEN ['F-' || claim_id % 4] ELSE ['F-' || claim_id % 4, 'F-' || claim_id % 3] END, lambda c: c <> 'F-3'), ',') AS codes FROM claims"""),
    "i04_label_unions": with_tables("docs cls", "SELECT source_code, string_agg(DISTINCT l, ',' ORDER BY l) AS labels, CAST(count(DISTINCT l) - max(n) AS INT) AS more FROM (SELECT source_code, len(labels) AS n, unnest(labels) AS l FROM cls JOIN docs ON id = doc_id) GROUP BY source_code"),
    "i05_shared_labels": with_tables("cls", "SELECT doc_id, CAST(len(list_filter(labels, lambda x: x IN ('PRODUCT_LAUNCH', 'FEE_BENEFIT_COMMISSION_CHANGE', 'SALES_DATA', 'DISTRIBUTION_CHANNEL'))) AS INT) AS common, len(list_filter(labels, lambda x: x IN ('PRODUCT_LAUNCH', 'FEE_BENEFIT_COMMISSION_CHANGE', 'SALES_DATA', 'DISTRIBUTION_CHANNEL'))) = 0 AS disjoint FROM cls"),
    "i07_within_allowed": with_tables("claims", "SELECT claim_id % 6 < 4 AS within, count(*) AS n FROM claims GROUP BY ALL"),
    "i08_closed_fields": with_tables("claims", "SELECT claim_id % 3 < 2 AS closed, count(*) AS n FROM claims GROUP BY ALL"),
    "i10_first_seen": "SELECT user_id, string_agg(event_type, ',' ORDER BY t, e) AS kinds FROM (SELECT user_id, event_type, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS e FROM events GROUP BY ALL) GROUP BY user_id",
    "k07_wide_dates": with_tables("facts", "SELECT code, strftime(make_date(2026, 5, CAST(pos % 31 + 1 AS INT)), '%Y-%m-%d') || ',' || strftime(make_date(2026, 6, CAST(pos % 28 + 1 AS INT)), '%Y-%m-%d') || ',2026-09-02' AS dates FROM facts"),
    "k15_hashes": "SELECT page_id, sha256(concat_ws(chr(10), url, html)) AS sha FROM pages",
    "k37_shown_labels": with_tables("src", """SELECT code, CASE authority WHEN 'REGULATOR' THEN 'Regulator' WHEN 'STATUTORY_DISCLOSURE' THEN 'Statutory disclosure' WHEN 'OFFICIAL_COMPANY' THEN 'Company' WHEN 'INDUSTRY_BODY' THEN 'Industry body' WHEN 'ESTABLISHED_MEDIA' THEN 'Media' ELSE 'Other' END AS authority,
      CASE WHEN primary_source THEN 'Primary' ELSE 'Secondary' END AS role, CASE market WHEN 'VN' THEN 'Vietnam' WHEN 'SG' THEN 'Singapore' WHEN 'GLOBAL' THEN 'Global' ELSE 'Global / regional' END AS market FROM src"""),
    "k41_fact_ages": with_tables("facts", f"SELECT CAST(greatest({_DAY} - published, 0) AS INT) AS age, count(*) AS n FROM facts WHERE published IS NOT NULL GROUP BY ALL"),
    "k44_actionable": with_tables("facts", f"SELECT status, status NOT IN ('EXPIRED', 'INVALID_DATE_RANGE') AS actionable, count(*) AS n FROM (SELECT CASE WHEN expiry < effective THEN 'INVALID_DATE_RANGE' WHEN expiry < {_DAY} THEN 'EXPIRED' WHEN effective > {_DAY} OR forecast > {_DAY} THEN 'UPCOMING' WHEN coalesce(effective, occurred, expiry) IS NOT NULL THEN 'ACTIVE' ELSE 'UNDATED' END AS status FROM facts) GROUP BY ALL"),
    "m34_cited_once": with_tables("facts", "SELECT source_code, source_code || ' ' || coalesce(strftime(published, '%Y-%m'), 'undated') AS label, min(code) AS code FROM facts GROUP BY ALL"),
    "l02_rebuilt_table": with_tables("src", "SELECT code, authority FROM src"),
    "a23_seeded_rules": with_tables("rules", "SELECT category, department FROM rules"),
}
