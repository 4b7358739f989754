"""Query objects: one JSON form of a whole query, checked against the catalog and compiled to a DataFrame.

    {"get_rows": "orders",
     "filter_rows": [{"column_id": "o_orderstatus", "value": "F", "is_negated": true},
                     {"join": "or", "filters": [...]}],
     "search": "words", "group_by": [{"column_id": "o_orderpriority"}],
     "sort_by": [{"column_id": "o_totalprice", "aggregate": "mean", "direction": "desc"}],
     "sample": 50, "seed": "a", "select": ["o_orderkey"], "page": 1, "per_page": 25, "cursor": "*"}

Filters at the top are joined by and. Text forms of single values are those of ``filters.from_text``. Text is compared
in any case, ids of a scheme in any spelling; the operator ``in collection`` takes a collection's name.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import ids
from tessera.operators import groups, paging, search
from tessera.operators.filters import Branch, Leaf, QueryError, compiled, from_text, in_any_case, kind_of, normal
from tessera.operators.joins import collection_ids, with_names
from tessera.sources.catalog import Entity, abilities, entity, resolved, scan

KNOWN = {"get_rows", "filter_rows", "search", "group_by", "sort_by", "sample", "seed", "select", "page", "per_page", "cursor", "include_unknown"}


def tree(raw: dict[str, Any], e: Entity, schema: T.StructType, collections: DataFrame | None = None) -> Leaf | Branch:
    """A filter in JSON as a tree of conditions on the entity's columns; collections: collection_id, entity_type, entity_id."""
    if "join" in raw:
        if raw["join"] not in ("and", "or"):
            raise QueryError(f"filters are joined by and or or, not {raw['join']!r}")
        return Branch(raw["join"], tuple(tree(x, e, schema, collections) for x in raw["filters"]), bool(raw.get("is_negated")))
    column = resolved(e, schema, raw["column_id"])
    kind = kind_of(schema, column)
    operator, value = raw.get("operator", "is"), raw.get("value")
    if operator in (">", ">=", "<", "<=", "between") and "range" not in abilities(kind):
        raise QueryError(f"{column} has no order to compare by")
    if operator == "in collection":
        if collections is None:
            raise QueryError("there are no collections to look in")
        return Leaf(column, tuple(collection_ids(collections, str(value), raw.get("entity", e.name))), "among", bool(raw.get("is_negated")))
    if column in e.schemes and operator in ("is", "in") and value is not None:
        value = [known_id(e.schemes[column], v) for v in value] if isinstance(value, list) else known_id(e.schemes[column], value)
    if operator == "has" and "search" not in abilities(kind):
        raise QueryError(f"{column} is no text")
    return Leaf(column, tuple(value) if isinstance(value, list) else value, operator, bool(raw.get("is_negated")))


def known_id(scheme: str, value: Any) -> Any:
    """A value as its scheme writes it; one that is none of its ids matches nothing, so it is an error."""
    if value is None:
        return None
    found = ids.canonical(scheme, str(value))
    if found is None:
        raise QueryError(f"{value!r} is not an id that fits")
    return found


def raw_of(f: Leaf | Branch) -> dict[str, Any]:
    """A tree of conditions in JSON."""
    if isinstance(f, Branch):
        return {"join": f.join, "filters": [raw_of(x) for x in f.filters], "is_negated": f.negated}
    value = list(f.value) if isinstance(f.value, tuple) else f.value
    return {"column_id": f.column, "value": value, "operator": f.operator, "is_negated": f.negated}


def canonical(query: dict[str, Any], e: Entity, schema: T.StructType) -> dict[str, Any]:
    """The same query in one spelling: column names resolved, NOT at the conditions, operands in a fixed order."""
    parts = [normal(tree(x, e, schema)) for x in query.get("filter_rows", [])]
    flat = [y for x in parts for y in (x.filters if isinstance(x, Branch) and x.join == "and" else [x])]
    return query | {"filter_rows": sorted((in_order(raw_of(x)) for x in flat), key=json_key)}


def in_order(raw: dict[str, Any]) -> dict[str, Any]:
    if "join" not in raw:
        return raw
    return raw | {"filters": sorted((in_order(x) for x in raw["filters"]), key=json_key)}


def json_key(x: Any) -> str:
    return json.dumps(x, sort_keys=True, default=str)


def filters_of_text(text: str, e: Entity, schema: T.StructType) -> list[dict[str, Any]]:
    """``key:value,key:value`` as filters; commas within quotes do not separate."""
    out, depth, part = [], False, ""
    for c in f"{text},":
        if c == '"':
            depth = not depth
        if c == "," and not depth:
            key, colon, value = part.partition(":")
            if not colon:
                raise QueryError(f"{part!r} is not in the form key:value")
            if re.search(r"\|\s*[A-Za-z_.-]+:", value) and '"' not in value:
                raise QueryError("alternatives are values of one key; other keys need a tree")
            column = resolved(e, schema, key.strip())
            out.append(raw_of(from_text(column, value, kind_of(schema, column))))
            part = ""
        else:
            part += c
    return out


def rows_of(spark: SparkSession, folder: str, query: dict[str, Any], tables: dict[str, DataFrame] | None, scored: bool) -> DataFrame:
    """All rows that the query's filters and search let through, with a score if it is asked for."""
    if unknown := set(query) - KNOWN:
        raise QueryError(f"unknown parts of a query: {', '.join(sorted(unknown))}")
    e = entity(query["get_rows"])
    df = (tables or {}).get(e.name)
    df = scan(spark, folder, e.name) if df is None else df
    conditions = [tree(x, e, df.schema, (tables or {}).get("collections")) for x in query.get("filter_rows", [])]
    if conditions:
        df = df.filter(compiled(in_any_case(Branch("and", tuple(conditions)), df.schema, e.codes), df.schema))
    if "search" in query:
        if not e.search:
            raise QueryError(f"{e.name} has no text to search")
        text = query["search"]
        plain = not set('"~*?') & set(text) and isinstance(search.joined(text), search.Word)
        if not plain:
            df = search.search(df, list(e.search), text)
            df = df.withColumn("score", search.boost(F.col(e.popularity)) if e.popularity else F.lit(1.0)) if scored else df
        else:
            df = search.ranked(df, e.search, text, e.popularity) if scored else search.across(df, list(e.search), text)
    return df


def total(spark: SparkSession, folder: str, query: dict[str, Any], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """How many rows the query has over all its pages: one row, count."""
    return rows_of(spark, folder, query, tables, False).agg(F.count("*").alias("count"))


def run(spark: SparkSession, folder: str, query: dict[str, Any], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The query's rows or buckets. tables stand in for the entities of their names, and hold the collections.

    A plain search is ranked where rows are asked for; for buckets and counts it is a filter only.
    """
    scored = "search" in query and not query.get("group_by") and "sample" not in query
    df, e = rows_of(spark, folder, query, tables, scored), entity(query["get_rows"])
    keys = [(x["column_id"], x.get("direction", "asc") == "desc", x.get("aggregate")) for x in query.get("sort_by", [])]
    if query.get("group_by"):
        return grouped(spark, folder, df, e, query, keys)
    if "sample" in query:
        if keys:
            raise QueryError("a sample has no order")
        df = paging.sample(df, query["sample"], e.unique, str(query.get("seed", "")))
    else:
        order = [(c if c == "score" and scored else resolved(e, df.schema, e.sort_as.get(c, c)), down) for c, down, _ in keys] or ([("score", True), *e.search_order] if scored else list(e.order))
        for c, _ in order:
            if "sort" not in abilities(kind_of(df.schema, c)):
                raise QueryError(f"{c} cannot be sorted by")
        per_page = query.get("per_page", 25)
        if "cursor" in query:
            df = paging.keyset_page(df, order, e.unique, query["cursor"], per_page)
        else:
            df = paging.page(df, order, e.unique, query.get("page", 1), per_page)
    return paging.selected(df, [resolved(e, df.schema, c) for c in query["select"]]) if "select" in query else df


def grouped(spark: SparkSession, folder: str, df: DataFrame, e: Entity, query: dict[str, Any], keys: list[tuple[str, bool, str | None]]) -> DataFrame:
    if "select" in query:
        raise QueryError("select does not go with group_by")
    columns = [resolved(e, df.schema, x["column_id"]) for x in query["group_by"]]
    for c in columns:
        if "group" not in abilities(kind_of(df.schema, c)):
            raise QueryError(f"{c} cannot be grouped by")
    unknown, limit = bool(query.get("include_unknown")), query.get("per_page", 200)
    if len(columns) > 1:
        if any(aggregate for _, _, aggregate in keys):
            raise QueryError("nested buckets are not sorted by a metric")
        return groups.nested(df, columns, limit, unknown)
    metric, order = None, "-count"
    for c, down, aggregate in keys[:1]:
        if aggregate:
            metric = aggregate, resolved(e, df.schema, c)
            order = f"{aggregate}_{metric[1]}"
        elif c in ("count", "key"):
            order = c
        else:
            raise QueryError("buckets are sorted by count, key or a metric")
        order = f"-{order}" if down else order
    buckets = groups.terms(df, columns[0], unknown, order, limit, metric)
    if columns[0] not in e.names:
        return buckets
    of, key, name = e.names[columns[0]]
    return with_names(buckets, "key", scan(spark, folder, of), key, name).orderBy(*groups.ordering(order))
