"""Entities: where their rows are, their id, their default order, and which columns allow what.

Any table can be an entity. What a column allows follows from its type: filters on all, ranges on numbers and times,
text search on strings, grouping on whatever is not a time, sorting on scalars. The driver's tables are registered here.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.filters import QueryError, dotted, kind_of


@dataclass(frozen=True)
class Entity:
    name: str
    #: The column, or columns together, that no two rows share.
    unique: str | tuple[str, ...]
    order: tuple[tuple[str, bool], ...] = ()
    #: Text columns by role: primary, secondary, tertiary.
    search: dict[str, str] = field(default_factory=dict)
    #: Other spellings of columns.
    aliases: dict[str, str] = field(default_factory=dict)
    popularity: str | None = None
    name_column: str | None = None
    #: Columns of codes in upper or lower case: values take that case, and the condition reaches the scan.
    codes: dict[str, str] = field(default_factory=dict)
    #: Order of a search's rows after the score.
    search_order: tuple[tuple[str, bool], ...] = ()
    #: Columns of ids in a public scheme, or of own ids (letters): values may be in any spelling.
    schemes: dict[str, str] = field(default_factory=dict)
    #: Names of grouped keys: column to entity, its key and its name.
    names: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    #: What sorting by a name means, where it is another column.
    sort_as: dict[str, str] = field(default_factory=dict)


ENTITIES = {
    e.name: e
    for e in (
        Entity("region", "r_regionkey", name_column="r_name"),
        Entity("nation", "n_nationkey", name_column="n_name"),
        Entity("customer", "c_custkey", (("c_acctbal", True),), {"c_name": "primary"}, name_column="c_name", names={"c_nationkey": ("nation", "n_nationkey", "n_name")}),
        Entity("supplier", "s_suppkey", (("s_acctbal", True),), {"s_name": "primary"}, name_column="s_name"),
        Entity("part", "p_partkey", (("p_retailprice", True),), {"p_name": "primary", "p_type": "secondary"}, name_column="p_name"),
        Entity("orders", "o_orderkey", (("o_totalprice", True),), aliases={"status": "o_orderstatus", "price": "o_totalprice"}, codes={"o_orderstatus": "upper", "o_orderpriority": "upper"}, sort_as={"year": "o_orderdate"}),
        Entity("lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), (("l_orderkey", False),), codes={"l_returnflag": "upper", "l_linestatus": "upper"}),
        Entity("events", "event_id", (("ts", True),)),
        Entity("documents", "doc_id", (("n_chars", True),), {"text": "primary"}, popularity="n_chars", codes={"lang": "lower"}, search_order=(("n_chars", True),)),
        Entity("embeddings", "vec_id"),
        Entity("pages", "page_id"),
        Entity("benchmark", "item_id", search={"text": "primary"}),
        Entity("labels", "doc_id"),
        Entity("conversations", ("conv_id", "turn"), (("conv_id", False),), {"text": "primary"}),
    )
}


def entity(name: str) -> Entity:
    if name not in ENTITIES:
        raise QueryError(f"there is no entity {name!r}{guess(name, list(ENTITIES))}")
    return ENTITIES[name]


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{entity(name).name}.parquet")


def guess(name: str, known: list[str]) -> str:
    close = difflib.get_close_matches(name, known, 1, 0.6)
    return f"; did you mean {close[0]!r}?" if close else ""


def resolved(e: Entity, schema: T.StructType, column: str) -> str:
    """The column's one name, from any of its spellings."""
    column = e.aliases.get(column, column)
    if column.split(".")[0] not in schema.fieldNames():
        column = column.replace("-", "_")
    try:
        kind_of(schema, column)
    except QueryError:
        raise QueryError(f"{column!r} is no column of {e.name}{guess(column, dotted(schema))}") from None
    return column


def abilities(kind: T.DataType) -> set[str]:
    """What a column of this type allows."""
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    out = {"filter", "select"}
    if isinstance(inner, T.StructType):
        return {"select"}
    if not isinstance(inner, T.DateType | T.TimestampType | T.TimestampNTZType | T.BinaryType):
        out.add("group")
    if isinstance(inner, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType):
        out.add("range")
    if isinstance(inner, T.StringType):
        out.add("search")
    if not isinstance(kind, T.ArrayType):
        out.add("sort")
    return out


def properties(df: DataFrame) -> list[tuple[str, str, list[str]]]:
    """Of each column and nested field: name, type, abilities."""
    return [(c, kind_of(df.schema, c).simpleString(), sorted(abilities(kind_of(df.schema, c)))) for c in dotted(df.schema)]


def counts(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """Rows per entity: entity, count."""
    parts = [scan(spark, folder, n).agg(F.count("*").alias("count")).select(F.lit(n).alias("entity"), "count") for n in names or ENTITIES]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
