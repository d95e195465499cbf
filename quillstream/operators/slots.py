"""Slots of an observation stream: islands between gaps, weighted votes, reliability, timing.

Everything is keyed by stream, so one exchange on stream_id serves the islands, and grouping by (stream, slot) adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BREAK_PERIODS, COPY_RELIABILITY, DT_DEFAULT_MS, DT_WINDOW, END, MIN_CONTROL_FRAMES, MIN_FRAMES_ERASURE, MIN_STATS, NONE, START, STATS_WINDOW

SLOT = ["stream_id", "slot_no"]


def votable(cls: Column) -> Column:
    return cls.isNotNull() & (cls != NONE)


def islands(obs: DataFrame) -> DataFrame:
    """Frames between gaps, numbered by the gaps before them."""
    upto = Window.partitionBy("stream_id").orderBy("t_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return obs.withColumn("slot_no", F.sum(F.col("gap").cast("int")).over(upto)).where(~F.col("gap")).drop("gap")


def votes(frames: DataFrame) -> DataFrame:
    """Weight, frames and first frame of each class in each slot."""
    return frames.where(votable(F.col("cls"))).groupBy(*SLOT, "cls").agg(F.sum("w").alias("weight"), F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def slots(frames: DataFrame) -> DataFrame:
    """One row for each slot: the class of greatest weight (the first seen on ties), its share and reliability.

    Control symbols need two frames. A slot without a class and with a single frame is noise and goes.
    """
    by_class = frames.groupBy(*SLOT, "cls").agg(F.sum("w").alias("weight"), F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.min("t_ms").alias("t_start"), F.max("t_ms").alias("t_end"))
    ok = votable(F.col("cls"))
    ballot = F.when(ok & (F.col("weight") > 0), F.struct("weight", (-F.col("first_seq")).alias("order"), "cls", "n"))
    rows = by_class.groupBy(*SLOT).agg(
        F.sum("n").alias("frames"),
        F.min("t_start").alias("t_start"),
        F.max("t_end").alias("t_end"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("accepted"),
        F.sum(F.when(ok, F.col("weight"))).alias("total"),
        F.max(ballot).alias("best"),
    )
    wins = F.col("best").isNotNull() & ~(F.col("best.cls").isin(START, END) & (F.col("best.n") < MIN_CONTROL_FRAMES))
    share = F.when(wins, F.col("best.weight") / F.col("total")).otherwise(0.0)
    out = rows.select(*SLOT, "frames", "t_start", "t_end", "accepted", F.when(wins, F.col("best.cls")).alias("cls"), share.alias("share"), F.when(wins, share * (1 - F.pow(F.lit(0.5), F.col("best.n")))).otherwise(0.0).alias("reliability"))
    return out.where(F.col("cls").isNotNull() | (F.col("frames") >= MIN_FRAMES_ERASURE))


def frame_intervals(obs: DataFrame, longest_ms: int) -> DataFrame:
    """Rolling median of the last valid intervals between frames; the default before there is one."""
    order = Window.partitionBy("stream_id").orderBy("t_ms", "seq")
    dt = F.col("t_ms") - F.lag("t_ms").over(order)
    valid = obs.withColumn("dt", dt).where((F.col("dt") > 0) & (F.col("dt") < longest_ms))
    recent = order.rowsBetween(-(DT_WINDOW - 1), 0)
    return valid.select("stream_id", "seq", "dt", F.coalesce(F.percentile("dt", 0.5).over(recent), F.lit(float(DT_DEFAULT_MS))).alias("frame_dt"))


def periods(rows: DataFrame) -> DataFrame:
    """Rolling median of the start-to-start intervals of slots, null until there are enough of them."""
    order = Window.partitionBy("stream_id").orderBy("slot_no")
    recent = order.rowsBetween(-(STATS_WINDOW - 1), 0)
    delta = rows.withColumn("delta", F.col("t_start") - F.lag("t_start").over(order)).where("delta > 0")
    return delta.select(*SLOT, "delta", F.when(F.count("delta").over(recent) >= MIN_STATS, F.percentile("delta", 0.5).over(recent)).alias("period"))


def indexed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("index", F.row_number().over(Window.partitionBy("stream_id").orderBy("slot_no")) - 1)


def breaks(rows: DataFrame, period_ms: int) -> DataFrame:
    """Slots that start more than BREAK_PERIODS periods after the one before, with the silence between them."""
    order = Window.partitionBy("stream_id").orderBy("slot_no")
    before = rows.withColumn("prev_start", F.lag("t_start").over(order)).withColumn("prev_end", F.lag("t_end").over(order))
    return before.where(F.col("t_start") - F.col("prev_start") > BREAK_PERIODS * period_ms).select(*SLOT, F.col("prev_end").alias("break_start"), F.col("t_start").alias("break_end"))


def fillers(rows: DataFrame, period_ms: int, usual_ms: int) -> DataFrame:
    """Slots that the clock says are missing, up to a break: copies of an overlong slot before them, at less reliability, then erasures."""
    order = Window.partitionBy("stream_id").orderBy("slot_no")
    before = {c: F.lag(c).over(order) for c in ("t_start", "t_end", "cls", "reliability")}
    known = rows.select(*SLOT, "t_start", *[v.alias(f"prev_{c}") for c, v in before.items()])
    delta = F.col("t_start") - F.col("prev_t_start")
    missing = F.round(delta / period_ms).cast("bigint") - 1
    copies = F.when(F.col("prev_cls").isNotNull(), F.round((F.col("prev_t_end") - F.col("prev_t_start") - usual_ms) / period_ms)).otherwise(0)
    known = known.withColumn("copies", copies).where((delta <= BREAK_PERIODS * period_ms) & (missing >= 1))
    filled = known.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), missing)))
    copy = F.col("i") <= F.col("copies")
    reliability = F.when(copy, F.round(COPY_RELIABILITY * F.col("prev_reliability"), 9)).otherwise(0.0)
    return filled.select(*SLOT, "i", (F.col("prev_t_start") + F.col("i") * period_ms).alias("t_start"), F.when(copy, F.col("prev_cls")).alias("cls"), reliability.alias("reliability"))
