"""All queries over the data model and their SQL equivalents."""

from .plans import admission, claims, corpus, dedup, events, labels, logs, parts, parts_sql, reports, review, rules, selection, texts, web

MODULES = (claims, admission, labels, events, dedup, logs, texts, web, corpus, reports, review, rules, selection, parts)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in (*MODULES[:-1], parts_sql) for name, sql in m.ORACLE_SQL.items()}
