"""Tables between the steps of a job: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new folder where it is unset and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return folder or own_folder()


@cache
def own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tessera-')}"


#: Spark's own switch for removing a query's shuffle files when it ends, rather than some time after.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> str:
    """Write df to a new folder of the shared one: its path. The shuffle files of the job go when it ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return path


def spool(df: DataFrame) -> DataFrame:
    """df as a table of its own: lineage ends there, and a lost executor costs nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))
