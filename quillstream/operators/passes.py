"""Passes over a repeated codeword: sessions between control symbols, candidate lengths, votes by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import END, MAX_PASSES, OPEN_PASS_SLACK, RELIABILITY_FLOOR, START
from ..functions.protocol import codeword_lengths


def symbols(slots: DataFrame) -> DataFrame:
    """Every symbol slot with its pass: pass_no, i, sym, rel, and the control that opened and that closed the pass."""
    stream = Window.partitionBy("stream_id").orderBy("slot_no")
    control = F.coalesce(F.col("cls").isin(START, END), F.lit(False))
    marked = slots.withColumn("control", control)
    marked = marked.withColumn("pass_no", F.sum(F.col("control").cast("int")).over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    seen = F.when(F.col("control"), F.col("cls"))
    marked = marked.withColumn("opened", F.last(seen, True).over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("closed", F.first(seen, True).over(stream.rowsBetween(1, Window.unboundedFollowing)))
    one = Window.partitionBy("stream_id", "pass_no").orderBy("slot_no")
    rel = F.when(F.col("cls").isNull(), 0.0).otherwise(F.greatest(F.lit(RELIABILITY_FLOOR), "reliability"))
    return marked.where(~F.col("control")).select("stream_id", "pass_no", (F.row_number().over(one) - 1).cast("bigint").alias("i"), F.col("cls").alias("sym"), rel.alias("rel"), "opened", "closed")


def passes(syms: DataFrame) -> DataFrame:
    """One row for each pass with any symbol."""
    flag = lambda c, k: F.coalesce(F.first(c) == k, F.lit(False))
    return syms.groupBy("stream_id", "pass_no").agg(
        F.count("*").alias("length"),
        flag("opened", START).alias("has_start"),
        flag("opened", END).alias("after_end"),
        flag("closed", END).alias("has_end"),
        F.first("closed").isNull().alias("is_current"),
    )


def anchored(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("is_current") & (F.col("has_start") | F.col("has_end")))


def last_passes(rows: DataFrame, keep: int = MAX_PASSES) -> DataFrame:
    age = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.col("pass_no").desc()))
    return anchored(rows).withColumn("age", age).where(F.col("age") <= keep).drop("age")


def used(rows: DataFrame) -> DataFrame:
    """The last anchored passes and, if it began with START, the one in progress."""
    return last_passes(rows).unionByName(rows.where("is_current AND has_start"))


def candidate_lengths(rows: DataFrame, syms: DataFrame) -> DataFrame:
    """stream_id, n, support, seen: codeword lengths that the passes speak for; seen tells which was spoken for first."""
    lengths = codeword_lengths(rows.sparkSession)
    first = syms.where("i = 0").select("stream_id", "pass_no", F.col("sym").alias("first_sym"), F.col("rel").alias("first_rel"))
    held = rows.join(first, ["stream_id", "pass_no"])
    offer = lambda n, w: F.struct(n.cast("bigint").alias("n"), w.cast("double").alias("weight"))
    near = [offer(F.col("length") + d, F.lit(2.0 if d == 0 else 0.5 / abs(d))) for d in (0, -2, -1, 1, 2)]
    closed = [offer(F.col("length") - 1, F.when(F.col("first_sym").isNull(), 1.5).otherwise(1.0)), offer(F.col("length"), F.lit(1.0))]
    offers = F.when(F.col("has_start") & F.col("has_end"), F.array(*near)).when(F.col("after_end") & F.col("has_end"), F.array(*closed)).otherwise(F.array().cast("array<struct<n:bigint,weight:double>>"))
    seen = lambda k: (F.col("pass_no") * 10 + k).cast("bigint").alias("seen")
    by_shape = held.select("stream_id", "pass_no", F.posexplode(offers).alias("k", "o")).select("stream_id", "o.n", "o.weight", seen(F.col("k"))).join(F.broadcast(lengths.select("n")), "n", "left_semi")
    named = held.where("has_start").join(F.broadcast(lengths), F.col("first_sym") == F.col("len")).select("stream_id", "n", (1 + F.col("first_rel")).alias("weight"), seen(F.lit(5)))
    return by_shape.unionByName(named).groupBy("stream_id", "n").agg(F.round(F.sum("weight"), 6).alias("support"), F.min("seen").alias("seen"))


def expected_length(support: DataFrame) -> DataFrame:
    """The best supported length of each stream; that which was spoken for first on ties."""
    return support.groupBy("stream_id").agg(F.max(F.struct("support", (-F.col("seen")).alias("o"), "n")).alias("x")).select("stream_id", F.col("x.n").alias("n"))


def position_votes(rows: DataFrame, syms: DataFrame, expected: DataFrame) -> DataFrame:
    """stream_id, n, pos, sym, weight, first_pass: head-aligned, or tail-aligned where only END was seen."""
    n, length = F.col("n"), F.col("length")
    fits = F.when(F.col("has_start") & F.col("has_end"), length == n).otherwise(length <= n + OPEN_PASS_SLACK)
    pos = F.when(F.col("has_start"), F.col("i")).otherwise(n - length + F.col("i"))
    held = rows.join(expected, "stream_id").where(fits).join(syms.select("stream_id", "pass_no", "i", "sym", "rel"), ["stream_id", "pass_no"])
    cast = held.where(F.col("sym").isNotNull()).withColumn("pos", pos).where((F.col("pos") >= 0) & (F.col("pos") < n))
    return cast.groupBy("stream_id", "n", "pos", "sym").agg(F.round(F.sum("rel"), 6).alias("weight"), F.min("pass_no").alias("first_pass"))


def margins(cast: DataFrame) -> DataFrame:
    """stream_id, n, pos, sym, margin: the winner of each position, the first cast on ties, and its lead over the next."""
    order = Window.partitionBy("stream_id", "n", "pos").orderBy(F.col("weight").desc(), "first_pass")
    ranked = cast.withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("weight", 1, 0.0).over(order))
    return ranked.where("r = 1").select("stream_id", "n", "pos", "sym", F.round(F.col("weight") - F.col("next"), 6).alias("margin"))


def least_reliable_first(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("stream_id").orderBy("margin", "pos")))
