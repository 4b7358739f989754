"""Stages of a corpus pipeline: each takes (spark, docs, sf_dir) and works on all rows of docs.

All but packing return the columns of docs. Nulls, empty texts and repeated rows are treated as the operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing as mixes
from tessera.llm import near_duplicates as near
from tessera.llm import packing as packs
from tessera.llm import pseudonyms as names
from tessera.llm import quality
from tessera.llm.queries import KEY, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id."""
    return near.deduplicated(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by pseudonyms; n_chars follows the text, if there is such a column."""
    out = names.pseudonymised(docs, key=KEY, counts=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixes.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in their sequences."""
    return packs.pieces(docs, vocabulary("word_bpe_49k.json")).drop("ids")
