"""The operators on their whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import interleaved, main_text, mixing, near_duplicates, packing, pseudonyms, quality, repeats, token_count, url_filter
from tessera.llm.common import scratch, table

TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "")
#: Key of the registered query and of the pipeline, which have to run anywhere; a deployment sets TESSERA_KEY.
KEY = os.environ.get("TESSERA_KEY") or "no secret: for tests and examples"


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents")).drop("spans")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).drop("ids")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key=KEY)


def op10_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pages = docs.select("doc_id", interleaved.as_page(F.col("doc_id"), F.col("text")).alias("html"))
    with scratch() as held:
        payloads = interleaved.figures(interleaved.media_store(docs, unique=False))
        out = interleaved.sequences(pages, payloads, "doc_id").filter("kind = 'media'")
        return held.keep(out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_repeats, op2_url_filter, op3_mixing, op4_packing, op5_main_text, op6_quality, op7_near_duplicates, op8_token_counts, op9_pseudonyms, op10_interleaved)}

ORACLE_SQL = {
    "op2_url_filter": r"""
        with parts as (
            select page_id,
                coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
            from pages),
        rules(verdict, rule_host, rule_path) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
            ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        fits as (
            select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
                arg_max(verdict, length(rule_host || rule_path)) as verdict
            from parts, rules
            where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
            group by page_id)
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join fits using (page_id)""",
}
