"""A corpus through toxicity, near-duplicates, decontamination, personal data and byte-level BPE.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of
documents, any further ones included; the last returns the encoded documents, with the columns named there and no others.
``run`` writes each stage's result as Parquet in the shared folder, reads it again for the next, and removes what the stage
before wrote.

A null or empty text is not toxic, no near-duplicate, not contaminated and holds no personal data: it stays, as null or empty,
and has no tokens. Rows that share a doc_id stay or go together as near-duplicates of one another; a row without doc_id is not
compared and stays. Equal rows get equal results. Without labels nothing is toxic, without benchmark items nothing is
contaminated; empty documents give no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import decontaminate, neardup, pii, tokenizer, toxicity
from quillstream.llm.queries import VOCABULARY, prepare, table
from quillstream.llm.runtime import remove, shared_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the least id. Five words, similarity of 0.8 or more."""
    prepare(spark)
    return neardup.kept_documents(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text; n_chars follows."""
    prepare(spark)
    return pii.masked(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids, token_ends, n_tokens. Other columns are not carried."""
    prepare(spark)
    return tokenizer.encoded(docs, public_tokenizers.path(VOCABULARY), keep=("lang", "source", "n_chars"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("encoding", encoding_stage),
]

#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:
            remove(spark, done)
        done = f"{folder}/{name}"
    return docs
