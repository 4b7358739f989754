"""Filters: trees of conditions as null-safe Spark columns.

A missing value matches nothing, and NOT is the complement: of all rows, those that do not match. NOT is pushed down to
the conditions first, and each condition has a negated form of its own. On scalar columns both forms reach the scan as
pushed filters: ``NOT (c <=> v)`` rather than ``NOT coalesce(c = v, false)``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import QueryError as QueryError
from tessera.functions import text as words

MOST_VALUES = 100
MOST_AMONG = 10_000
OPERATORS = ("is", "in", "term", "among", ">", ">=", "<", "<=", "between", "has", "prefix", "contains_all")


@dataclass(frozen=True)
class Leaf:
    """One condition on one column. value None stands for a missing value."""

    column: str
    value: Any = None
    operator: str = "is"
    negated: bool = False


@dataclass(frozen=True)
class Branch:
    """Conditions joined by and, or."""

    join: str
    filters: tuple[Leaf | Branch, ...] = field(default_factory=tuple)
    negated: bool = False


def all_of(*filters: Leaf | Branch) -> Branch:
    return Branch("and", filters)


def any_of(*filters: Leaf | Branch) -> Branch:
    return Branch("or", filters)


def negate(f: Leaf | Branch) -> Leaf | Branch:
    return replace(f, negated=not f.negated)


def normal(f: Leaf | Branch, negated: bool = False) -> Leaf | Branch:
    """NOT only at the leaves; nested branches of the same kind joined, single ones unwrapped."""
    negated ^= f.negated
    if isinstance(f, Leaf):
        return replace(f, negated=negated)
    join = {"and": "or", "or": "and"}[f.join] if negated else f.join
    parts: list[Leaf | Branch] = []
    for x in f.filters:
        part = normal(x, negated)
        parts += part.filters if isinstance(part, Branch) and part.join == join else [part]
    return parts[0] if len(parts) == 1 else Branch(join, tuple(dict.fromkeys(parts)))


def literal(value: Any, kind: T.DataType) -> Column:
    """value as a literal of the column's type, so that the column itself is never cast."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.BooleanType):
        if isinstance(value, str) and value.lower() not in ("true", "false"):
            raise QueryError(f"{value!r} is not true or false")
        return F.lit(value if isinstance(value, bool) else value.lower() == "true")
    if isinstance(kind, T.NumericType):
        try:
            number = float(value)
        except (TypeError, ValueError):
            raise QueryError(f"{value!r} is not a number") from None
        if isinstance(kind, T.IntegralType):
            # A fraction equals no whole number; as a double it keeps its order.
            return F.lit(int(number)).cast(kind) if number.is_integer() else F.lit(number)
        return F.lit(number).cast(kind)
    if isinstance(kind, T.DateType):
        return F.lit(value if isinstance(value, date) else parsed_day(value))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        try:
            return F.lit(value if isinstance(value, datetime) else datetime.fromisoformat(str(value).replace("Z", "+00:00"))).cast(kind)
        except ValueError:
            raise QueryError(f"{value!r} is not a time in the form yyyy-mm-ddThh:mm:ss") from None
    return F.lit(str(value))


def parsed_day(value: str) -> date:
    try:
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            raise ValueError
        return date.fromisoformat(value)
    except ValueError:
        raise QueryError(f"{value!r} is not a date in the form yyyy-mm-dd") from None


def a_day(value: Any, kind: T.DataType) -> bool:
    """Whether a value names a whole day on a column of times."""
    return isinstance(kind, T.TimestampType | T.TimestampNTZType) and isinstance(value, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", value) is not None


def condition(f: Leaf, c: Column, kind: T.DataType) -> Column:
    """The leaf on column c of this type; never null.

    ``is`` compares as it is put, ``term`` strings (one or several) in any case, ``among`` up to 10,000 values. A day on
    a column of times is all of that day.
    """
    if isinstance(kind, T.ArrayType):
        return on_array(f, c, kind.elementType)
    if f.operator == "term":
        values = f.value if isinstance(f.value, tuple | list) else (f.value,)
        low = tuple(None if v is None else str(v).lower() for v in values)
        return condition(Leaf(f.column, low if len(low) > 1 else low[0], "in" if len(low) > 1 else "is", f.negated), F.lower(c), kind)
    if f.operator == "among":
        known = [literal(v, kind) for v in dict.fromkeys(f.value) if v is not None]
        if len(known) > MOST_AMONG:
            raise QueryError(f"at most {MOST_AMONG} values can be looked among")
        inside = c.isNotNull() & c.isin(*known) if known else F.lit(False)
        return ~inside if f.negated else inside
    if f.operator == "is" and a_day(f.value, kind):
        begin = datetime.combine(parsed_day(f.value), datetime.min.time())
        lo, hi = literal(begin, kind), literal(begin + timedelta(days=1), kind)
        return c.isNull() | (c < lo) | (c >= hi) if f.negated else c.isNotNull() & (c >= lo) & (c < hi)
    if f.operator == "in" and any(a_day(v, kind) for v in f.value):
        parts = [condition(Leaf(f.column, v), c, kind) for v in dict.fromkeys(f.value)]
        found = parts[0]
        for x in parts[1:]:
            found = found | x
        return ~found if f.negated else found
    if f.value is None and f.operator in ("is", "in"):
        return c.isNotNull() if f.negated else c.isNull()
    if f.operator == "is":
        same = c.eqNullSafe(literal(f.value, kind))
        return ~same if f.negated else same
    if f.operator == "in":
        values = list(dict.fromkeys(f.value))
        if len(values) > MOST_VALUES:
            raise QueryError(f"at most {MOST_VALUES} values can be joined by or")
        known = [literal(v, kind) for v in values if v is not None]
        missing = None in values
        if f.negated:
            inside = ~c.isin(*known) if known else F.lit(True)
            return c.isNotNull() & inside if missing else c.isNull() | inside
        inside = c.isNotNull() & c.isin(*known) if known else F.lit(False)
        return c.isNull() | inside if missing else inside
    positive, negative = comparisons(f, c, kind)
    return c.isNull() | negative if f.negated else c.isNotNull() & positive


def comparisons(f: Leaf, c: Column, kind: T.DataType) -> tuple[Column, Column]:
    """The condition and its opposite, where c is not null."""
    v = f.value
    if f.operator == "between":
        lo, hi = (literal(x, kind) for x in v)
        return (c >= lo) & (c <= hi), (c < lo) | (c > hi)
    if f.operator == "prefix":
        return c.startswith(str(v)), ~c.startswith(str(v))
    if f.operator == "has":
        found = words.has_all(words.tokens(c), words.query_tokens(str(v)))
        return found, ~found
    if f.operator not in (">", ">=", "<", "<="):
        raise QueryError(f"operator {f.operator!r} does not fit a {kind.simpleString()} column")
    x = literal(v, kind)
    return {">": (c > x, c <= x), ">=": (c >= x, c < x), "<": (c < x, c >= x), "<=": (c <= x, c > x)}[f.operator]


def on_array(f: Leaf, c: Column, kind: T.DataType) -> Column:
    """Array columns match if some element does; an array without a known element is missing."""
    if f.value is None and f.operator in ("is", "in"):
        present = F.coalesce(F.exists(c, lambda x: x.isNotNull()), F.lit(False))
        return present if f.negated else ~present
    if f.operator == "contains_all":
        found = F.lit(True)
        for v in f.value:
            found = found & F.coalesce(F.array_contains(c, literal(v, kind)), F.lit(False))
    elif f.operator == "is":
        found = F.coalesce(F.array_contains(c, literal(f.value, kind)), F.lit(False))
    else:
        inner = replace(f, negated=False)
        found = F.coalesce(F.exists(c, lambda x: condition(inner, x, kind)), F.lit(False))
    return ~found if f.negated else found


def in_any_case(f: Leaf | Branch, schema: T.StructType, codes: dict[str, str]) -> Leaf | Branch:
    """f with values of string columns compared in any case; codes (column: upper or lower) have one, so they reach the scan."""
    if isinstance(f, Branch):
        return replace(f, filters=tuple(in_any_case(x, schema, codes) for x in f.filters))
    kind = kind_of(schema, f.column)
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if f.operator not in ("is", "in") or f.value is None or not isinstance(inner, T.StringType):
        return f
    if f.column in codes:
        one = lambda v: getattr(str(v), codes[f.column])() if v is not None else None
        return replace(f, value=tuple(map(one, f.value)) if f.operator == "in" else one(f.value))
    return replace(f, operator="term")


def kind_of(schema: T.StructType, path: str) -> T.DataType:
    """Type of a dotted path; through an array of structs it is an array of the field."""
    kind: T.DataType = schema
    many = False
    for name in path.split("."):
        if isinstance(kind, T.ArrayType):
            many, kind = True, kind.elementType
        if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
            raise QueryError(f"{path} is not a valid column; valid are {', '.join(sorted(dotted(schema)))}")
        kind = kind[name].dataType
    return T.ArrayType(kind) if many and not isinstance(kind, T.ArrayType) else kind


def dotted(schema: T.StructType, prefix: str = "") -> list[str]:
    """All columns and fields as dotted names."""
    out = []
    for f in schema.fields:
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        out.append(prefix + f.name)
        if isinstance(kind, T.StructType):
            out += dotted(kind, f"{prefix}{f.name}.")
    return out


def compiled(f: Leaf | Branch, schema: T.StructType) -> Column:
    """A tree of conditions as one column."""
    return column_of(normal(f), schema)


def column_of(f: Leaf | Branch, schema: T.StructType) -> Column:
    if isinstance(f, Leaf):
        return condition(f, F.col(f.column), kind_of(schema, f.column))
    out = F.lit(f.join == "and")
    for i, x in enumerate(f.filters):
        part = column_of(x, schema)
        out = part if not i else out & part if f.join == "and" else out | part
    return out


def from_text(column: str, value: str, kind: T.DataType) -> Leaf | Branch:
    """The condition that a short text form stands for.

    ``!`` in front negates all of it; ``|`` separates alternatives; ``null`` is a missing value; quotes keep a value
    together; on numbers ``a-b``, ``a-``, ``-b``, ``<a`` and ``>a`` are ranges; elsewhere blanks separate values that
    all have to match.
    """
    if value.strip().lower() in ("", "none", "undefined"):
        raise QueryError(f"{column} needs a value")
    negated = value.startswith("!")
    rest = value[1:] if negated else value
    options = rest.split("|")
    if not negated and any(x.startswith("!") for x in options[1:]):
        raise QueryError("the ! has to come first, and holds for all alternatives")
    options = [x.removeprefix("!") for x in options]
    if len(options) > MOST_VALUES:
        raise QueryError(f"at most {MOST_VALUES} values can be joined by or")
    leaves = [option(column, x, kind) for x in options]
    if len(leaves) > 1 and all(x.operator == "is" for x in leaves):
        return Leaf(column, tuple(x.value for x in leaves), "in", negated)
    out = leaves[0] if len(leaves) == 1 else Branch("or", tuple(leaves))
    return negate(out) if negated else out


def option(column: str, value: str, kind: T.DataType) -> Leaf:
    if value == "null":
        return Leaf(column)
    if len(value) > 1 and value[0] == value[-1] == '"':
        return Leaf(column, value[1:-1])
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if isinstance(inner, T.NumericType):
        number = r"\d+(?:\.\d+)?"
        if m := re.fullmatch(rf"({number})-({number})", value):
            return Leaf(column, (m[1], m[2]), "between")
        if m := re.fullmatch(rf"({number})-", value):
            return Leaf(column, m[1], ">=")
        if m := re.fullmatch(rf"-({number})", value):
            return Leaf(column, m[1], "<=")
        if m := re.fullmatch(rf"([<>]=?)(-?{number})", value):
            return Leaf(column, m[2], m[1])
    elif value[0] in "<>":
        op = value[:2] if value[1:2] == "=" else value[0]
        return Leaf(column, value[len(op) :], op)
    if isinstance(kind, T.ArrayType) and " " in value and not isinstance(inner, T.NumericType | T.BooleanType):
        return Leaf(column, tuple(value.split()), "contains_all")
    return Leaf(column, value)
