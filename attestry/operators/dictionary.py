"""Texts against a dictionary of aliases, as a join on the aliases' rarest words.

An alias stands in a text where its signs stand in lower case with no letter or digit directly
before or after.  ``marked`` writes the start and end of every word, and every place between
two other signs, into a text, so that this becomes a plain search for the marked alias: no
pattern per alias, and a plan that does not grow with the dictionary.

Each alias is indexed by one of its words, the one that the fewest aliases hold.  The distinct
words of a text meet the index in a join, and only aliases that share their word with the text
are searched for.  A small dictionary is broadcast behind a count of its rows and bytes, and
texts stay where they are; beyond that, words are shuffled without their texts, and the aliases
found meet the texts again by a hash.

Defined cases: a null or blank text, and a null alias, give no rows; an alias without a letter or
digit is left out; repeated rows of texts or aliases give rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dictionary of more rows or bytes than these is not broadcast.
SMALL_ROWS, SMALL_BYTES = 1 << 17, 1 << 23

_START, _END, _BETWEEN = "\x02", "\x03", "\x04"


def marked(text: Column) -> Column:
    """A text in lower case with its word boundaries written out."""
    plain = F.translate(F.lower(text), _START + _END + _BETWEEN, "\x01\x01\x01")
    between = F.regexp_replace(plain, r"(?<![\p{L}\p{N}])(?![\p{L}\p{N}])", _BETWEEN)
    return F.regexp_replace(between, r"([\p{L}\p{N}]+)", f"{_START}$1{_END}")


def words_of(marks: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(marks, F.lit(f"{_START}([^{_END}]+){_END}"), 1))


def indexed(aliases: DataFrame, alias: str) -> DataFrame:
    """The aliases with ``__pattern``, what to search for, and ``__word``, where to look it up."""
    rows = aliases.withColumn("__pattern", marked(F.col(alias))).withColumn("__words", words_of(F.col("__pattern")))
    spread = rows.select("__pattern", F.explode("__words").alias("__word")).distinct()
    shared = spread.groupBy("__word").agg(F.count("*").alias("__n"))
    rarest = F.min_by("__word", F.struct("__n", (-F.length("__word")).alias("long"), "__word")).alias("__word")
    heads = spread.join(shared, "__word").groupBy("__pattern").agg(rarest)
    return rows.drop("__words").join(heads, "__pattern")


def found(texts: DataFrame, text: str, aliases: DataFrame, alias: str, small_rows: int = SMALL_ROWS, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """The columns of both sides, a row for each text and each alias that stands in it."""
    index = indexed(aliases, alias)
    rows, size = aliases.agg(F.count(alias), F.coalesce(F.sum(F.octet_length(F.col(alias))), F.lit(0))).first()
    marks = texts.withColumn("__marks", marked(F.col(text)))
    if rows <= small_rows and size <= small_bytes:
        near = marks.withColumn("__word", F.explode(words_of(F.col("__marks")))).join(F.broadcast(index), "__word")
    else:
        keyed = marks.withColumn("__key", F.xxhash64("__marks"))
        asked = keyed.select("__key", F.explode(words_of(F.col("__marks"))).alias("__word")).distinct()
        near = keyed.join(asked.join(index, "__word").drop("__word"), "__key")
    return near.where(F.contains("__marks", "__pattern")).select(*texts.columns, *aliases.columns)
