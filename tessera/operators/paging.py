"""Order, pages, samples and projections."""

from __future__ import annotations

import base64
import json
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.filters import QueryError, kind_of, literal

MOST_PER_PAGE, MOST_ROWS, MOST_SAMPLED = 200, 10_000, 10_000


def sort_keys(text: str) -> list[tuple[str, bool]]:
    """``a:desc,b`` as columns and whether they descend."""
    out = []
    for part in text.split(","):
        name, _, way = part.strip().partition(":")
        if way not in ("", "asc", "desc"):
            raise QueryError(f"sort is asc or desc, not {way!r}")
        out.append((name.replace("-", "_"), way == "desc"))
    return out


def unique_columns(unique: str | tuple[str, ...]) -> tuple[str, ...]:
    return (unique,) if isinstance(unique, str) else unique


def total(keys: list[tuple[str, bool]], unique: str | tuple[str, ...]) -> list[tuple[str, bool]]:
    """keys, with the column or columns that tell rows apart at the end, so that no two rows tie."""
    have = {k for k, _ in keys}
    return [*keys, *[(k, False) for k in unique_columns(unique) if k not in have]]


def order(keys: list[tuple[str, bool]]) -> list[Column]:
    """Missing values come last either way."""
    return [F.desc_nulls_last(k) if down else F.asc_nulls_last(k) for k, down in keys]


def page(df: DataFrame, keys: list[tuple[str, bool]], unique: str | tuple[str, ...], number: int = 1, per_page: int = 25) -> DataFrame:
    """A page by its number; a top-k of the first rows, never a full sort on one machine."""
    if not 1 <= per_page <= MOST_PER_PAGE:
        raise QueryError(f"a page has 1 to {MOST_PER_PAGE} rows")
    if number < 1 or number * per_page > MOST_ROWS:
        raise QueryError(f"pages reach up to {MOST_ROWS} rows; go on with a cursor")
    return df.orderBy(*order(total(keys, unique))).offset((number - 1) * per_page).limit(per_page)


def beyond(df: DataFrame, keys: list[tuple[str, bool]], last: list) -> Column:
    """Whether a row comes after one with these sort values."""
    out = F.lit(False)
    for (k, down), v in reversed(list(zip(keys, last, strict=True))):
        c = F.col(k)
        value = literal(v, kind_of(df.schema, k))
        later = F.lit(False) if v is None else c.isNull() | ((c < value) if down else (c > value))
        out = F.coalesce(later, F.lit(False)) | (c.eqNullSafe(value) & out)
    return out


def keyset_page(df: DataFrame, keys: list[tuple[str, bool]], unique: str | tuple[str, ...], cursor: str | None = None, per_page: int = 25) -> DataFrame:
    """The page after a cursor; the scan skips what came before by a filter, however deep the page."""
    keys = total(keys, unique)
    rows = df if cursor in (None, "*") else df.filter(beyond(df, keys, decoded(cursor)))
    return rows.orderBy(*order(keys)).limit(per_page)


def encoded(values: list) -> str:
    """Sort values of a page's last row as a cursor."""
    plain = [x.isoformat() if isinstance(x, date | datetime) else x for x in values]
    return base64.urlsafe_b64encode(json.dumps(plain).encode()).decode()


def decoded(cursor: str) -> list:
    try:
        return json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except ValueError:
        raise QueryError("the cursor is not valid") from None


def sample(df: DataFrame, n: int, unique: str | tuple[str, ...], seed: str = "") -> DataFrame:
    """n rows in an order that only the seed and the id decide, the same on every run and engine."""
    if not 1 <= n <= MOST_SAMPLED:
        raise QueryError(f"a sample has 1 to {MOST_SAMPLED} rows")
    columns = unique_columns(unique)
    name = F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns])
    return df.orderBy(F.md5(name), *columns).limit(n)


def any_row(df: DataFrame) -> DataFrame:
    """One row at random."""
    return df.orderBy(F.rand()).limit(1)


def selected(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns and nested fields in the order named; a nested field is called after its path."""
    for c in columns:
        kind_of(df.schema, c)
    return df.select(*[F.col(c).alias(c.replace(".", "_")) if "." in c else F.col(c) for c in columns])
