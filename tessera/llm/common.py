"""What several operators share: spooled tables and their removal, bounded broadcasts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.spool import written

#: A word, in the form that all contracts use.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table that may be broadcast after they were counted.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written within the innermost ``scratch`` block, per thread.
HELD: ContextVar[list[str] | None] = ContextVar("held", default=None)


def spool(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    path = written(df)
    if (held := HELD.get()) is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Spooled tables of a block of steps."""

    def __init__(self) -> None:
        self.results: list[DataFrame] = []

    def keep(self, *results: DataFrame) -> DataFrame:
        """Tables that these read outlast the block."""
        self.results += results
        return results[0]


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Tables spooled within are removed at the end, but for those that the kept results read."""
    block, outer = Scratch(), HELD.get()
    token = HELD.set([])
    try:
        yield block
        folders = HELD.get()
    finally:
        HELD.reset(token)
    read = {f.rstrip("/").split("/tessera-")[-1].split("/")[0] for r in block.results for f in r.inputFiles() if "/tessera-" in f}
    for path in folders:
        if path.split("/tessera-")[-1] in read:
            if outer is not None:
                outer.append(path)
        elif block.results:
            remove(block.results[0].sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a spooled table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (a spooled table), marked for broadcast if it was counted to be small; else any join strategy."""
    return F.broadcast(df) if df.count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores if df has such a column, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def batch_bytes(spark: SparkSession, rows: int = 2000, megabytes: int = 16) -> None:
    """Arrow batches to Python stay small even where texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def uniform(*parts: Column | str) -> Column:
    """A double in (0, 1) that depends on the parts only; MD5, so that other engines can repeat it."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)
