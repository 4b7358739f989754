"""A corpus from raw documents to packed sequences: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages
from tessera.llm.common import spool, table

STAGES = [
    ("quality rules", stages.quality_rules),
    ("near-duplicates", stages.near_duplicates),
    ("pseudonyms", stages.pseudonyms),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

#: The stages hold expectation-maximisation, hashing and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = spool(docs)
    return docs
