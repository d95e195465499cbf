"""Exact length histogram of encoded documents (operator 6).

Documents are counted by encoded length; suffix sums over that histogram answer, for every context limit, how many
documents fit, what the corpus totals, what it totals when each document is truncated there, and any quantile.
Each task counts before the shuffle, so a hot source or a group of copies costs one row a length. The suffix sums run
within blocks of lengths; only block totals (one row for every ``BLOCK`` lengths) meet in a single task.

A null or empty text has length 0 and counts as a document. An empty table gives no rows; asked for limits or quantiles, it
gives none either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut
from .tokenizer import length_histogram

#: Lengths to a block of the suffix sums.
BLOCK = 4096


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length as context limit: n_tokens, n_docs, docs_longer, docs_fitting, total_tokens, tokens_fitting, truncated_tokens, share_fitting."""
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("block_docs").over(whole).alias("all_docs"),
        F.sum("block_tokens").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("docs_above")
    beyond = F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("tokens_above")
    return (
        h.join(blocks, "block")
        .withColumn("docs_longer", longer)
        .withColumn("beyond", beyond)
        .select(
            "n_tokens",
            "n_docs",
            "docs_longer",
            (F.col("all_docs") - F.col("docs_longer")).alias("docs_fitting"),
            "total_tokens",
            (F.col("total_tokens") - F.col("beyond")).alias("tokens_fitting"),
            (F.col("total_tokens") - F.col("beyond") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_tokens"),
            ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("share_fitting"),
        )
    )


def token_counts(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    return suffix_sums(cut(length_histogram(docs, path, text_col=text_col)))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_longer, truncated_tokens, total_tokens for any limits, whether or not a document has that length.

    The limits become columns, so one pass over the sums answers all of them.
    """
    every = F.col("docs_fitting") + F.col("docs_longer")
    answers = []
    for limit in limits:
        fits = F.when(F.col("n_tokens") <= limit, F.col("n_tokens"))
        best = F.max_by(F.struct("docs_longer", "tokens_fitting"), fits)
        longer = F.coalesce(best["docs_longer"], F.max(every))
        truncated = F.coalesce(best["tokens_fitting"], F.lit(0)) + longer * F.lit(int(limit))
        answers.append(F.struct(F.lit(int(limit)).cast("bigint").alias("context_limit"), longer.alias("docs_longer"), truncated.alias("truncated_tokens"), F.max("total_tokens").alias("total_tokens")))
    return sums.agg(F.array(*answers).alias("a")).select(F.inline("a")).where("total_tokens IS NOT NULL")


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length that at least this share of the documents does not exceed."""
    answers = [F.struct(F.lit(float(x)).alias("share"), F.min(F.when(F.col("share_fitting") >= float(x), F.col("n_tokens"))).alias("n_tokens")) for x in shares]
    return sums.agg(F.array(*answers).alias("a")).select(F.inline("a")).where("n_tokens IS NOT NULL")


def report(docs: DataFrame, path: str, limits: list[int], shares: list[float]) -> DataFrame:
    """``token_counts`` (what = 'length'), and the same of the given context limits ('limit') and quantiles ('quantile').

    A limit's n_docs counts the documents of just that length; a quantile has its share, and no sums but those of its length.
    """
    sums = cut(token_counts(docs, path))
    columns = [c for c in sums.columns if c not in ("n_tokens", "n_docs")]
    at = at_limits(sums, limits).withColumnRenamed("context_limit", "n_tokens")
    own = sums.select("n_tokens", F.col("n_docs").alias("own_docs"), F.col("docs_fitting").alias("fitting"))
    every = F.max(F.col("docs_fitting") + F.col("docs_longer"))
    at = at.withColumn("every", F.lit(sums.agg(every).first()[0]))
    fitting = F.col("every") - F.col("docs_longer")
    limit_rows = at.join(own, "n_tokens", "left").select(
        F.lit("limit").alias("what"),
        "n_tokens",
        F.coalesce("own_docs", F.lit(0)).alias("n_docs"),
        "docs_longer",
        fitting.alias("docs_fitting"),
        "total_tokens",
        (F.col("truncated_tokens") - F.col("docs_longer") * F.col("n_tokens")).alias("tokens_fitting"),
        "truncated_tokens",
        (fitting / F.col("every")).alias("share_fitting"),
    )
    quantile_rows = quantiles(sums, shares).join(sums.drop("share_fitting"), "n_tokens").select(F.lit("quantile").alias("what"), "n_tokens", "n_docs", *columns[:-1], F.col("share").alias("share_fitting"))
    return sums.select(F.lit("length").alias("what"), "n_tokens", "n_docs", *columns).unionByName(limit_rows).unionByName(quantile_rows)
