"""The queries of this subpackage: each operator over its whole table, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.llm import (ann, divergence, embedding_dedup, language, licenses, mixing, packing,
                           sharding, simhash, spelling, substrings, token_counts, warc)
from guardlake.llm.common import table


def op1_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identified(table(spark, folder, "documents"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    prints = simhash.stored(simhash.with_fingerprint(docs, "text", "print"), "simhash-prints")
    return simhash.near_duplicates(prints).select(
        "doc_id", simhash.as_hex("print").alias("fingerprint"), "component_id")


def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.document_tokens(table(spark, folder, "documents"), tokenizer_path(
        "piece_bpe_32k.model"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents"))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_audit(table(spark, folder, "documents"))


def op12_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeats_removed(table(spark, folder, "documents"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_embedding_dedup, op2_language, op3_mixing, op4_simhash, op5_neighbours, op6_warc,
        op7_token_counts, op8_sharding, op9_licenses, op10_packing, op11_divergence,
        op12_substrings, op13_spelling, pipeline)}
ORACLES: dict[str, str] = {
    "op1_embedding_dedup": embedding_dedup.ORACLE, "op3_mixing": mixing.ORACLE,
    "op6_warc": warc.ORACLE, "op9_licenses": licenses.ORACLE,
    "op11_divergence": divergence.ORACLE, "op12_substrings": substrings.ORACLE}
