"""Vector search by exact similarity, with filters before it and popularity after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.filters import QueryError

MOST_NEIGHBOURS = 200


def dot(vector: Column, query: Sequence[float]) -> Column:
    """Inner product with a fixed vector; null where the lengths differ."""
    fixed = F.lit([float(x) for x in query])
    return F.when(F.size(vector) == len(query), F.aggregate(F.zip_with(vector, fixed, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x))


def cosine(vector: Column, query: Sequence[float]) -> Column:
    size = sum(x * x for x in query) ** 0.5
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot(vector, query) / (norm * F.lit(size))


def nearest(df: DataFrame, row_id: str, vector: str, query: Sequence[float], k: int = 10, least: float | None = None, where: Column | None = None) -> DataFrame:
    """The k rows of highest cosine similarity among those that pass ``where``: a top-k of each task, then of all."""
    if not 1 <= k <= MOST_NEIGHBOURS:
        raise QueryError(f"k is 1 to {MOST_NEIGHBOURS}")
    rows = df if where is None else df.filter(where)
    rows = rows.withColumn("score", cosine(F.col(vector), query)).filter(F.col("score").isNotNull())
    if least is not None:
        rows = rows.filter(F.col("score") >= least)
    return rows.orderBy(F.desc("score"), row_id).limit(k)


def saturated(score: Column, count: Column, floor: float = 0.5, weight: float = 0.5, half: float = 100.0) -> Column:
    """score, raised by popularity: half of the most at ``half`` counts, and only as far as the score is above floor."""
    c = F.coalesce(count, F.lit(0)).cast("double")
    gate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - floor) / (1 - floor)))
    return score * (1 + weight * gate * c / (c + half))


def log_scaled(score: Column, count: Column) -> Column:
    """score, times 1 + the logarithm of a count, or 1/2 where that is at most 1 or missing."""
    return score * F.when(count.isNull() | (count <= 1), 0.5).otherwise(1 + F.log(count.cast("double")))


def rescored(hits: DataFrame, row_id: str, count: str, **how) -> DataFrame:
    """hits in the order of their saturated scores."""
    return hits.withColumn("score", saturated(F.col("score"), F.col(count), **how)).orderBy(F.desc("score"), row_id)


def log_rescored(hits: DataFrame, row_id: str, count: str) -> DataFrame:
    return hits.withColumn("score", log_scaled(F.col("score"), F.col(count))).orderBy(F.desc("score"), row_id)


def with_injected(hits: DataFrame, others: DataFrame, row_id: str) -> DataFrame:
    """hits, and those of others that are not among them, at the median score of the hits."""
    middle = hits.agg(F.percentile("score", 0.5).alias("score"))
    fresh = others.join(hits.select(row_id), row_id, "left_anti").crossJoin(F.broadcast(middle))
    return hits.unionByName(fresh.select(*hits.columns))
