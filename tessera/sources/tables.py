"""Writers and rewrites of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import QueryError


def read(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | None = None, **options) -> DataFrame:
    """A table in any of Spark's formats; csv and json should come with a schema."""
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


FORMS = ("parquet", "orc", "json", "csv")


def write(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None, **options) -> None:
    """A table, partitioned by columns if they are named. A csv has no nested columns: they become JSON."""
    if form not in FORMS:
        raise QueryError(f"tables are written as {', '.join(FORMS)}, not {form!r}")
    if form == "csv":
        df = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else F.col(f.name) for f in df.schema])
    writer = df.write.format(form).mode("overwrite").options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table whose rows are dealt to buckets by key: lookups read one bucket, joins on the key move no row."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)


def export_groups(buckets: DataFrame, path: str) -> None:
    """Buckets as csv files with a header, as many as Spark deals them to."""
    buckets.write.mode("overwrite").csv(path, header=True)


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text in a column json."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def without(df: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is in removed."""
    return df.join(removed.select(key).distinct(), key, "left_anti")


def upserted(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """df with the rows of changes in place of, or besides, its own; of several changes of a key the last row in their order by all columns."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in changes.columns]))
    fresh = changes.withColumn("__at", last).filter("__at = 1").drop("__at")
    return without(df, fresh, key).unionByName(fresh)


def with_elements(df: DataFrame, column: str, keep, count: str | None = None) -> DataFrame:
    """df with only those elements of an array column that keep accepts, and their number."""
    out = df.withColumn(column, F.filter(column, keep))
    return out.withColumn(count, F.coalesce(F.size(column), F.lit(0))) if count else out


def truncated(df: DataFrame, column: str, most: int, flag: str | None = None) -> DataFrame:
    """df with at most so many elements of an array column, and whether any were left out; the full array stays in the table."""
    out = df.withColumn(flag, F.coalesce(F.size(column) > most, F.lit(False))) if flag else df
    return out.withColumn(column, F.slice(column, 1, most))


def linked(df: DataFrame, out: str, when: Column, base: str, row_id: str, ending: str = "") -> DataFrame:
    """df with the address of a row's content where a condition says that there is one, else null."""
    return df.withColumn(out, F.when(when, F.concat(F.lit(base), F.col(row_id).cast("string"), F.lit(ending))))


def overridden(df: DataFrame, key: str, column: str, values: dict[str, str]) -> DataFrame:
    """df with the column's value replaced for the keys named in a small fixed table."""
    out = F.col(column)
    for k, v in values.items():
        out = F.when(F.col(key) == k, F.lit(v)).otherwise(out)
    return df.withColumn(column, out)


def map_rows(column: str):
    """A map's entries as rows key, count, to be used in select with explode."""
    return F.explode(F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("count"))))


def index_of_words(tokens: Column) -> Column:
    """JSON word positions of an array of tokens (letters and digits only), by one sort; null for null."""

    def written(words: Column) -> Column:
        pairs = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))
        return F.when(F.size(words) > 0, F.get(F.transform(F.array(pairs), lists), F.lit(0))).when(words.isNotNull(), F.lit("{}"))

    def lists(s: Column) -> Column:
        def piece(x: Column, k: Column) -> Column:
            before = F.get(s, k - 1)["word"]
            return F.when(x["word"] == before, F.concat(F.lit(","), x["at"])).otherwise(F.concat(F.when(k == 0, F.lit('{"')).otherwise(F.lit('],"')), x["word"], F.lit('":['), x["at"]))

        return F.concat(F.array_join(F.transform(s, piece), ""), F.lit("]}"))

    # Within a transform of one element its value is made once, however often it is named.
    return F.get(F.transform(F.array(tokens), written), F.lit(0))


def positions_of_words(df: DataFrame, column: str, out: str) -> DataFrame:
    """A column of JSON word positions, ``{"word": [0, 7]}``, as a map; null where the JSON is broken."""
    return df.withColumn(out, F.from_json(F.col(column), T.MapType(T.StringType(), T.ArrayType(T.IntegerType())), {"mode": "PERMISSIVE"}))


def text_of_positions(positions: str):
    """The text that word positions stand for."""
    pairs = F.flatten(F.transform(F.map_entries(positions), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.sort_array(pairs), lambda x: x["word"]), " ")
