"""Grouping: documents per key, with the forms that a faceted search needs.

A multi-valued column counts a row once under each of its different keys. Keys are exact, never sampled; partial sums
are made before each shuffle. Buckets are ordered by a total order, so results agree between runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.filters import QueryError, kind_of

UNKNOWN = "unknown"
METRICS = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
MOST_LEVELS = 3


def keyed(df: DataFrame, column: str | Column, out: str = "key", unknown: bool = False) -> DataFrame:
    """df with a row per different key of the column; without one only if unknown."""
    c = F.col(column) if isinstance(column, str) else column
    kind = df.select(c.alias("c")).schema["c"].dataType
    if isinstance(kind, T.ArrayType):
        known = F.array_compact(F.array_distinct(c))
        if unknown:
            known = F.when(F.size(F.coalesce(known, F.array())) == 0, F.array(F.lit(UNKNOWN))).otherwise(known.cast("array<string>"))
        return df.withColumn(out, F.explode(known))
    if unknown:
        return df.withColumn(out, F.coalesce(c.cast("string"), F.lit(UNKNOWN)))
    return df.withColumn(out, c).filter(F.col(out).isNotNull())


def ordering(order: str) -> list[Column]:
    """Of buckets: count, -count, key, -key, or the name of a metric column with - for descending."""
    name, down = order.removeprefix("-"), order.startswith("-")
    first = F.desc_nulls_last(name) if down else F.asc_nulls_last(name)
    return [first] if name == "key" else [first, F.asc("key")]


def terms(df: DataFrame, column: str | Column, unknown: bool = False, order: str = "-count", limit: int | None = None, metric: tuple[str, str] | None = None) -> DataFrame:
    """key and count, and the metric (name, column) of each key's rows, e.g. ("mean", "price") as mean_price."""
    rows = keyed(df, column, unknown=unknown).groupBy("key")
    measures = [F.count("*").alias("count")]
    if metric:
        name, of = metric
        if name not in METRICS or not isinstance(kind_of(df.schema, of), T.NumericType):
            raise QueryError(f"{name} of {of} is not a metric")
        measures.append(METRICS[name](of).alias(f"{name}_{of}"))
    out = rows.agg(*measures).orderBy(*ordering(order))
    return out.limit(limit) if limit is not None else out


def nested(df: DataFrame, columns: list[str], top: int, unknown: bool = False) -> DataFrame:
    """The top keys of the first column, of each the top keys of the second, and so on: key_1 ... key_n, count.

    count_1 ... are the counts of the outer buckets. Each level ranks within its parent.
    """
    if not 1 <= len(columns) <= MOST_LEVELS:
        raise QueryError(f"between 1 and {MOST_LEVELS} columns can be grouped")
    names = [f"key_{i + 1}" for i in range(len(columns))]
    rows = reduce(lambda d, x: keyed(d, x[0], x[1], unknown), zip(columns, names, strict=True), df)
    kept = None
    for i in range(len(columns)):
        level = rows if kept is None else rows.join(kept, names[:i], "left_semi")
        counts = level.groupBy(*names[: i + 1]).agg(F.count("*").alias(f"count_{i + 1}"))
        by = Window.partitionBy(*names[:i]) if i else Window.partitionBy()
        place = F.row_number().over(by.orderBy(F.desc(f"count_{i + 1}"), names[i]))
        if i:
            best = counts.withColumn("place", place).filter(F.col("place") <= top).drop("place")
            kept = kept.join(best, names[:i])
        else:
            kept = counts.orderBy(F.desc("count_1"), names[0]).limit(top)
    return kept


def facets(df: DataFrame, columns: list[str], top: int | None = None, unknown: bool = False) -> DataFrame:
    """Several groupings of the same rows in one pass: facet, key, count."""
    parts = []
    for c in columns:
        kind = kind_of(df.schema, c)
        values = F.array_compact(F.array_distinct(F.col(c))).cast("array<string>") if isinstance(kind, T.ArrayType) else F.array_compact(F.array(F.col(c).cast("string")))
        values = F.coalesce(values, F.array().cast("array<string>"))
        if unknown:
            values = F.when(F.size(values) == 0, F.array(F.lit(UNKNOWN))).otherwise(values)
        parts.append(F.transform(values, facet_key(c)))
    out = df.select(F.explode(F.concat(*parts)).alias("x")).groupBy("x.facet", "x.key").agg(F.count("*").alias("count"))
    if top is None:
        return out
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("count"), "key"))
    return out.withColumn("place", place).filter(F.col("place") <= top).drop("place")


def facet_key(name: str):
    return lambda v: F.struct(F.lit(name).alias("facet"), v.alias("key"))


def overlapping(df: DataFrame, buckets: dict[str, Column]) -> DataFrame:
    """Counts of named conditions, which may overlap, in one pass: key, count."""
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"n{i}") for i, c in enumerate(buckets.values())])
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"n{i}").alias("count")) for i, k in enumerate(buckets)])
    return counts.select(F.explode(pairs).alias("x")).select("x.key", "x.count")


def presence(df: DataFrame, column: str) -> DataFrame:
    """Rows with and without a value: key (true, false), count."""
    c = F.col(column)
    there = F.coalesce(F.exists(c, lambda x: x.isNotNull()), F.lit(False)) if isinstance(kind_of(df.schema, column), T.ArrayType) else c.isNotNull()
    return overlapping(df, {"true": there, "false": ~there})


def zero_filled(buckets: DataFrame, possible: DataFrame, key: str) -> DataFrame:
    """buckets (key, count) with count 0 for possible keys that have none."""
    return possible.select(F.col(key).alias("key")).distinct().join(buckets, "key", "left").select("key", F.coalesce("count", F.lit(0)).alias("count"))


def through(df: DataFrame, column: str, dim: DataFrame, member: str, group: str, row_id: str) -> DataFrame:
    """Rows per group that a small table maps the keys to, such as countries to regions; a row counts once per group."""
    rows = keyed(df, column).join(dim.select(F.col(member).alias("key"), F.col(group).alias("of")), "key")
    return rows.groupBy(F.col("of").alias("key")).agg(F.countDistinct(row_id).alias("count"))


def after(buckets: DataFrame, last: object | None, size: int) -> DataFrame:
    """A page of buckets in key order: those after the last key seen."""
    rows = buckets if last is None else buckets.filter(F.col("key") > F.lit(last))
    return rows.orderBy("key").limit(size)


def named_like(buckets: DataFrame, names: DataFrame, key: str, name: str, q: str) -> DataFrame:
    """buckets with their names, those whose name has q in it."""
    known = names.select(F.col(key).alias("key"), F.col(name).alias("key_display_name"))
    return buckets.join(known, "key").filter(F.contains(F.lower("key_display_name"), F.lit(q.lower())))


def years_like(prefix: str) -> tuple[int, int]:
    """The years that begin with these digits: 1 to 1000-1999, 20 to 2000-2099."""
    if not prefix.isdigit() or len(prefix) > 4:
        raise QueryError(f"{prefix!r} does not begin a year")
    step = 10 ** (4 - len(prefix))
    return int(prefix) * step, int(prefix) * step + step - 1


def stats(df: DataFrame, column: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, sum and exact quantiles (p25, p50, p75) of a column, in between two values by their distance: one row.

    One pass gives approximate quantiles a little to either side of each, which bound where the exact ones are; the next
    counts what lies below each such bracket and the values within. Brackets that hold more than ``FEW`` rows are
    narrowed in the same way. So no task and not the driver ever holds more than that.
    """
    known = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    both = known.agg(F.count("*").alias("n"), F.sum("v").alias("sum")).first()
    kind = known.schema["v"].dataType
    exact = T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()
    places = [s * (both.n - 1) for s in shares]
    found = order_statistics(known, both.n, {int(p) for p in places} | {min(int(p) + 1, both.n - 1) for p in places}) if both.n else {}
    at = lambda p: float(found[int(p)]) + (float(found[min(int(p) + 1, both.n - 1)]) - float(found[int(p)])) * (p - int(p)) if both.n else None
    names = [f"p{round(100 * s)}" for s in shares]
    schema = T.StructType([T.StructField("count", T.LongType()), T.StructField("sum", exact), *[T.StructField(x, T.DoubleType()) for x in names]])
    total = None if both.sum is None else (int if isinstance(exact, T.LongType) else float)(both.sum)
    return df.sparkSession.createDataFrame([(both.n, total, *[at(p) for p in places])], schema)


#: Rows of a bracket whose values come to the driver.
FEW, ACCURACY = 50_000, 2_000


def order_statistics(values: DataFrame, n: int, ranks: set[int]) -> dict[int, object]:
    """The values (column v, no nulls) of these ranks from 0, by narrowing brackets around each."""
    out: dict[int, object] = {}
    # Of each open rank: the ends of its bracket, rows below it, rows within.
    brackets = dict.fromkeys(ranks, (None, None, 0, n))
    while brackets:
        wide = {r: b for r, b in brackets.items() if b[3] > FEW}
        asked = [F.percentile_approx(F.when(inside(b), F.col("v")), [max(0.0, (r - b[2]) / b[3] - 2 / ACCURACY), min(1.0, (r - b[2]) / b[3] + 2 / ACCURACY)], ACCURACY) for r, b in wide.items()]
        ends = list(values.agg(*[a.alias(f"e{i}") for i, a in enumerate(asked)]).first()) if asked else []
        tried = {r: (lo, hi) for r, (lo, hi) in zip(wide, ends, strict=True)} | {r: b[:2] for r, b in brackets.items() if r not in wide}
        sums = [F.count_if(F.col("v") < (F.lit(lo) if lo is not None else F.col("v"))) for lo, _ in tried.values()] + [F.count_if(inside(b)) for b in tried.values()]
        counts = list(values.agg(*[x.alias(f"c{i}") for i, x in enumerate(sums)]).first())
        now = {}
        for i, (r, (lo, hi)) in enumerate(tried.items()):
            below, within = counts[i], counts[len(tried) + i]
            if not below <= r < below + within:
                lo, hi, below, within = brackets[r]
            elif lo is not None and lo == hi:
                out[r] = lo
                continue
            now[r] = (lo, hi, below, within)
        for r, b in now.items():
            if b[3] <= FEW or b == brackets[r]:
                seen = b[2]
                for v, k in values.filter(inside(b)).groupBy("v").agg(F.count("*").alias("k")).orderBy("v").collect():
                    seen += k
                    if seen > r:
                        out[r] = v
                        break
        brackets = {r: b for r, b in now.items() if r not in out}
    return out


def inside(bracket: tuple) -> Column:
    lo, hi = bracket[:2]
    return F.lit(True) if lo is None else (F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi))


def addressed(buckets: DataFrame, base: str) -> DataFrame:
    """Buckets with their keys as addresses; keys that are addresses already stay."""
    key = F.col("key").cast("string")
    return buckets.withColumn("key", F.when(key.startswith("http") | (key == UNKNOWN), key).otherwise(F.concat(F.lit(base), key)))


def merged(buckets: DataFrame) -> DataFrame:
    """Buckets of equal keys as one: their counts are added."""
    return buckets.groupBy("key").agg(F.sum("count").alias("count"))


def beginning(buckets: DataFrame, *prefixes: str) -> DataFrame:
    """Buckets whose key begins with one of these."""
    found = F.lit(False)
    for p in prefixes:
        found = found | F.col("key").cast("string").startswith(p)
    return buckets.filter(found)


def groups_count(df: DataFrame, column: str, unknown: bool = False) -> DataFrame:
    """How many buckets a grouping has in all: one row, groups_count."""
    return keyed(df, column, unknown=unknown).agg(F.countDistinct("key").alias("groups_count"))


def histogram(df: DataFrame, column: str, interval: float, least: int = 1) -> DataFrame:
    """Rows per interval of the column: key (its lower end), count; intervals with fewer than ``least`` are left out."""
    key = (F.floor(F.col(column) / interval) * interval).alias("key")
    return df.filter(F.col(column).isNotNull()).groupBy(key).agg(F.count("*").alias("count")).filter(F.col("count") >= least)


def value_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """For each value of a filter how many rows match it, and all rows: one pass."""
    return overlapping(df, {"total": F.lit(True), **conditions})
