"""Joins behind a search: names, collections, citations, redirects, versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.filters import QueryError, kind_of
from tessera.sources.spool import spool

MOST_IDS = 10_000


def with_names(df: DataFrame, key: str, names: DataFrame, name_key: str, name: str, out: str = "key_display_name", known_only: bool = False) -> DataFrame:
    """df with the name of its key; Catalyst broadcasts the names if they are small."""
    known = names.select(F.col(name_key).alias("__key"), F.col(name).alias(out))
    return df.join(known, F.col(key) == F.col("__key"), "inner" if known_only else "left").drop("__key")


def union_of(names: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Several tables of names (table, key, name) as one: entity, id, display_name."""
    return reduce(DataFrame.unionByName, [t.select(F.lit(e).alias("entity"), F.col(k).cast("string").alias("id"), F.col(n).alias("display_name")) for e, (t, k, n) in names.items()])


def in_collection(df: DataFrame, column: str, collections: DataFrame, collection: str, entity: str, negated: bool = False) -> DataFrame:
    """Rows whose column has an id of the collection (collection_id, entity_type, entity_id), or those without.

    An unknown or empty collection has no ids. A collection of another entity is an error, found by a look at the few
    rows of that collection.
    """
    own = collections.filter(F.col("collection_id") == collection)
    if not own.filter(F.col("entity_type") != entity).isEmpty():
        raise QueryError(f"{collection} is not a collection of {entity}")
    if own.limit(MOST_IDS + 1).count() > MOST_IDS:
        raise QueryError(f"a collection has at most {MOST_IDS} ids")
    kind = kind_of(df.schema, column)
    if isinstance(kind, T.ArrayType):
        # No more than MOST_IDS values: a hash set in the filter, so rows with arrays need no join.
        ids = [r.id for r in own.select(F.col("entity_id").cast(kind.elementType).alias("id")).distinct().collect()]
        found = F.coalesce(F.exists(column, lambda x: F.coalesce(x.isin(*ids), F.lit(False))), F.lit(False)) if ids else F.lit(False)
        return df.filter(~found if negated else found)
    return df.join(own.select(F.col("entity_id").cast(kind).alias("__id")), F.col(column) == F.col("__id"), "left_anti" if negated else "left_semi")


def collection_ids(collections: DataFrame, collection: str, entity: str) -> list[str]:
    """The ids of a collection of this entity, at most MOST_IDS, for conditions within a tree."""
    rows = collections.filter(F.col("collection_id") == collection).select("entity_type", "entity_id").distinct().limit(MOST_IDS + 1).collect()
    if any(r.entity_type != entity for r in rows):
        raise QueryError(f"{collection} is not a collection of {entity}")
    if len(rows) > MOST_IDS:
        raise QueryError(f"a collection has at most {MOST_IDS} ids")
    return [r.entity_id for r in rows]


def named_by(df: DataFrame, row_id: str, edges: DataFrame, source: str, target: str, of: object, negated: bool = False) -> DataFrame:
    """Rows that the row ``of`` points at by an edge (cited by it, related to it)."""
    ids = edges.filter(F.col(source) == F.lit(of)).select(F.col(target).alias("__id")).distinct()
    return df.join(ids, F.col(row_id) == F.col("__id"), "left_anti" if negated else "left_semi")


def pointing_at(df: DataFrame, row_id: str, edges: DataFrame, source: str, target: str, to: object) -> DataFrame:
    """Rows that point at the row ``to`` (that cite it)."""
    return named_by(df, row_id, edges, target, source, to)


def redirected(df: DataFrame, column: str, aliases: DataFrame, old: str, new: str) -> DataFrame:
    """df with merged ids replaced by those that they were merged into."""
    names = aliases.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    out = df.join(names, F.col(column) == F.col("__old"), "left")
    return out.withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def newest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Of the rows of each key the one that is last in this order."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc_nulls_last(o) for o in order]))
    return df.withColumn("__at", at).filter("__at = 1").drop("__at")


def union_all(tables: dict[str, DataFrame], entity: str = "entity") -> DataFrame:
    """Rows of several entities as one table, with the entity's name; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(entity, F.lit(n)) for n, t in tables.items()])


def descendants(edges: DataFrame, parent: str, child: str, most_levels: int | None = None) -> DataFrame:
    """Number of all descendants of each node: ancestor, n. A level is a join; levels go on until one has nothing new.

    In a cycle a node is its own descendant. most_levels, if given, is an error where there are more levels.
    """
    step = spool(edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("node")).distinct())
    down = step.select(F.col("ancestor").alias("__up"), F.col("node").alias("below"))
    reached, level, n = step, step, 0
    while True:
        # A table of its own each level: lineage stays short, and pairs met before end cycles.
        level = level.join(down, F.col("node") == F.col("__up")).select("ancestor", F.col("below").alias("node")).distinct()
        met = reached.select(F.col("ancestor").alias("__ancestor"), F.col("node").alias("__node"))
        level = spool(level.join(met, F.col("ancestor").eqNullSafe(F.col("__ancestor")) & F.col("node").eqNullSafe(F.col("__node")), "left_anti"))
        if level.isEmpty():
            return reached.groupBy("ancestor").agg(F.countDistinct("node").alias("n"))
        n += 1
        if most_levels is not None and n > most_levels:
            raise QueryError(f"the tree has more than {most_levels} levels below its nodes' children")
        reached = reached.union(level)
