"""Autocomplete, suggestions and lookup by identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as words

EXACT, PRIMARY = 2e6, 1e6


def completions(df: DataFrame, row_id: str, name: str, q: str, popularity: Column | None = None, others: list[str] | None = None, limit: int = 10) -> DataFrame:
    """Rows whose name, or some other field, begins with q as a phrase.

    Equal names come first, then matches of the name itself, then the popular ones.
    """
    main = words.has_phrase_prefix(F.col(name), q)
    found = main
    for c in others or []:
        found = found | words.has_phrase_prefix(F.col(c), q)
    known = F.log1p(F.coalesce(popularity.cast("double"), F.lit(0.0))) if popularity is not None else F.lit(0.0)
    score = F.when(F.lower(F.col(name)) == q.lower(), EXACT).otherwise(0.0) + F.when(main, PRIMARY).otherwise(0.0) + known
    return df.filter(found).withColumn("score", score).orderBy(F.desc("score"), row_id).limit(limit)


def suggestions(df: DataFrame, phrase: str, count: str, q: str, limit: int = 10) -> DataFrame:
    """Phrases that begin with q, the most frequent first; nothing for fewer than three letters."""
    if len(q) < 3:
        return df.limit(0)
    starts = F.startswith(F.lower(F.col(phrase)), F.lit(q.lower()))
    return df.filter(starts).orderBy(F.desc(count), phrase).limit(limit)


def by_id(df: DataFrame, column: str, value: object) -> DataFrame:
    """The row with this id; the filter reaches the scan."""
    return df.filter(F.col(column) == F.lit(value))


def by_name(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.filter(F.lower(F.col(column)) == value.lower())


def by_external_id(df: DataFrame, row_id: str, links: DataFrame, external: str, internal: str, value: object) -> DataFrame:
    """The row that an id of another scheme leads to."""
    own = links.filter(F.col(external) == F.lit(value)).select(F.col(internal).alias("__id")).distinct()
    return df.join(own, F.col(row_id) == F.col("__id"), "left_semi")


def value_suggestions(df: DataFrame, column: str, q: str, limit: int = 10) -> DataFrame:
    """Values of a column that begin with q in some word, the most frequent first: key, count. For filling in a filter."""
    known = df.filter(words.has_phrase_prefix(F.col(column).cast("string"), q))
    return known.groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key").limit(limit)
