"""Small automata over one text that no built-in function expresses, as Arrow-batched functions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: A string of JSON whose inner quotes may lack their escape: a quote closes it before : } ] or the end, or before a comma and a quote.
_CLOSES = r"(?=\s*(?:[:}\]]|$|,\s*\"))"
_STRING = re.compile(rf'"((?:\\.|[^"\\]|"(?!\s*(?:[:}}\]]|$|,\s*")))*)(?:"{_CLOSES}|$)', re.S)
_SIGN = re.compile(r'"(?:\\.|[^"\\])*"|[{}]', re.S)


def repaired(raw: str) -> str:
    """JSON text with the quotes inside of strings escaped."""

    def one(match: re.Match) -> str:
        inner = re.sub(r'\\.|"', lambda m: m.group() if len(m.group()) == 2 else '\\"', match.group(1), flags=re.S)
        return f'"{inner}"' if match.group().endswith('"') and len(match.group()) > 1 else f'"{inner}'

    return _STRING.sub(one, raw)


def balanced_object(text: str, start: int = 0) -> str | None:
    """The first JSON object of a text: from a brace to the one that closes it, strings not counted."""
    first = text.find("{", start)
    if first < 0:
        return None
    depth = 0
    for sign in _SIGN.finditer(text, first):
        depth += {"{": 1, "}": -1}.get(sign.group(), 0)
        if depth == 0:
            return text[first : sign.end()]
    return None


def article_nodes(state: str, most_depth: int = 80) -> list[tuple[str, str]]:
    """(title, day) of the article objects of an embedded page state, however deep they lie."""
    try:
        todo = [(json.loads(state), 0)]
    except ValueError:
        return []
    found = []
    while todo:
        node, depth = todo.pop()
        if depth > most_depth:
            continue
        if isinstance(node, dict):
            if node.get("_content_type_uid") == "article" and "post_date" in node:
                found.append((str(node.get("title", "")), str(node["post_date"])))
            todo += [(child, depth + 1) for child in reversed(node.values())]
        elif isinstance(node, list):
            todo += [(child, depth + 1) for child in reversed(node)]
    return found


@F.pandas_udf(StringType())
def repair_json(raw: pd.Series) -> pd.Series:
    return raw.map(repaired, na_action="ignore")


@F.pandas_udf(StringType())
def first_object(text: pd.Series) -> pd.Series:
    return text.map(balanced_object, na_action="ignore")


@F.pandas_udf(ArrayType(StructType([StructField("title", StringType()), StructField("day", StringType())])))
def embedded_articles(state: pd.Series) -> pd.Series:
    return state.map(lambda s: [{"title": t, "day": d} for t, d in article_nodes(s or "")])
