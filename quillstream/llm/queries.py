"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from . import decontaminate, fingerprints, neardup, oracles, passages, pii, sentences, sharding, token_counts, tokenizer, toxicity

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def prepare(spark: SparkSession) -> None:
    """The package goes to the workers, and texts to Python a thousand at a time: with long documents, ten thousand would be too much at once."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents").select("doc_id"), SHARDS).select("doc_id", "slot", "shard_no", "shard")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every length that occurs, context limits from 128 to a million tokens, and quantiles."""
    return token_counts.report(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), [1 << k for k in range(7, 21)], [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0])


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.without_repeated_runs(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_fingerprints,
        op2_byte_bpe,
        op3_toxicity,
        op4_personal_data,
        op5_sharding,
        op6_token_counts,
        op7_near_duplicates,
        op8_repeated_passages,
        op9_sentence_spans,
        op10_decontamination,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracles.sql(SHARDS)
