"""Exact segmentation and decoding, in batch and as streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import END, NONE, START
from ..functions import protocol as P
from ..functions.reed_solomon import first_messages
from ..operators import slots as S
from ..operators.calibration import Calibration
from ..operators.ordered import array_of, in_event_time, in_order, mark_of_the_end, to_the_end
from ..operators.reception import LOST, Asking, Reception, alignment, erasing_weakest, one_mended
from ..operators.segmentation import SLOT_COLUMNS, Segmentation
from ..registry import query, table
from ..shipping import ship
from ..sources.views import epoch_ms, observations, payloads, sql
from ..streaming.files import remove, shared_folder, stream_table
from .protocol import KEYS, codeword_oracle, word_column
from .quality import CAL_EXPECTED


class Segmenting:
    """Frames (t, gap, cls, p) to slots."""

    def __init__(self):
        self.own = Segmentation()

    def feed(self, c: dict[str, np.ndarray]) -> list[tuple]:
        return self.own.feed(c["t"], c["gap"], np.where(c["cls"] < 0, NONE, c["cls"]), c["p"])

    def close(self) -> list[tuple]:
        return self.own.close()


class Receiving:
    """Slots (cls, reliability) to the text and length of a message."""

    def __init__(self):
        self.own = Reception()

    def feeding(self, c: dict[str, np.ndarray]) -> Asking:
        return self._told((yield from self.own.feeding(np.where(c["cls"] < 0, LOST, c["cls"]), c["reliability"])))

    def closing(self) -> Asking:
        return self._told((yield from self.own.closing()))

    @staticmethod
    def _told(m) -> list[tuple]:
        return [(m.payload.decode("utf-8", "replace"), m.n)] if m else []


# --- a camera's view of the events: each user's events are symbols that are shown one after the other


#: Frames of 50 ms: six show the symbol, two the gap after it; and a silence now and then.
FRAME_MS, SHOWN, FRAMES, SILENCE_MS = 50, 6, 8, 5000


def shown_frames(spark: SparkSession, d: str) -> DataFrame:
    """stream_id, t, gap, cls, p: frames with every fault that the segmenter mends, at places that the number of the symbol tells.

    From the eleventh symbol on, of every eleven: one has two frames without class, one two frames of a wrong class, one is
    missed, one has a gap in its midst, and one runs into the next. Before one in 33 nothing is seen for SILENCE_MS.
    """
    stream = Window.partitionBy("stream_id")
    k = F.get_json_object("props", "$.k").cast("int")
    shown = table(spark, d, "events").select(F.col("user_id").alias("stream_id"), "event_id", F.floor(k / 12).cast("int").alias("sym"))
    shown = shown.withColumn("i", F.row_number().over(stream.orderBy("event_id")) - 1).withColumn("left", F.count("*").over(stream) - 1 - F.col("i"))
    i, f, sym = F.col("i"), F.col("f"), F.col("sym")
    turn = F.when(i >= 11, i % 11).otherwise(-1)
    gap = (f >= SHOWN) & ~((turn == 9) & (F.col("left") >= 2)) | (turn == 5) & (F.col("left") >= 1) | (turn == 7) & (f == 3)
    cls = F.when((turn == 2) & f.isin(0, 5) | (f >= SHOWN), None).when((turn == 3) & f.isin(1, 4), (sym + 1) % 9).otherwise(sym)
    start = i * FRAMES * FRAME_MS + F.floor((i + 10) / 33) * SILENCE_MS
    frames = shown.select("stream_id", "i", "left", "sym", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))).alias("f"))
    return frames.select("stream_id", (start + f * FRAME_MS).cast("double").alias("t"), gap.alias("gap"), cls.cast("int").alias("cls"), F.when((turn == 3) & f.isin(1, 4), 0.6).otherwise(1.0).alias("p"))


_SHOWN_SLOTS = f"""
WITH shown AS (
    SELECT user_id AS stream_id, CAST(floor(k / 12) AS INT) AS sym, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, lag(CAST(floor(k / 12) AS INT)) OVER o AS before, lead(CAST(floor(k / 12) AS INT)) OVER o AS after
    FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k FROM events) WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
timed AS (
    SELECT *, CAST({FRAMES * FRAME_MS} * i + {SILENCE_MS} * ((i + 10) // 33) AS DOUBLE) AS t0, CASE WHEN i >= 11 THEN i % 11 ELSE -1 END AS turn, i + (i + 10) // 33 AS place FROM shown),
judged AS (
    SELECT *, turn = 5 AND i < n - 1 AS missed, turn = 10 AND i >= 20 AND i < n - 1 AND sym = before AS covered, turn = 9 AND i < n - 2 AS runs_on FROM timed)
SELECT stream_id, place AS slot_index, CASE WHEN NOT missed THEN sym END AS cls,
    CASE WHEN missed THEN 0.0 WHEN turn = 3 THEN round(4 / 5.2, 9) ELSE 1.0 END AS share,
    round(CASE WHEN missed THEN 0.0 WHEN covered THEN 0.6 * (1 - pow(0.5, 12)) WHEN turn = 3 THEN 4 / 5.2 * (1 - pow(0.5, 4)) WHEN turn = 2 THEN 1 - pow(0.5, 4)
        WHEN turn = 7 THEN 1 - pow(0.5, 5) WHEN runs_on AND sym = after THEN 1 - pow(0.5, 12) ELSE 1 - pow(0.5, 6) END, 9) AS reliability,
    CAST(CASE WHEN missed OR covered THEN 0 WHEN turn = 2 THEN 4 WHEN turn = 7 THEN 5 WHEN runs_on AND sym = after THEN 12 ELSE 6 END AS INT) AS accepted,
    CAST(CASE WHEN missed OR covered THEN 0 WHEN turn = 7 THEN 5 WHEN runs_on AND sym = after THEN 14 WHEN runs_on THEN 8 ELSE 6 END AS INT) AS frames,
    t0 AS t_start, t0 + CASE WHEN missed OR covered THEN 0 WHEN runs_on AND sym = after THEN 700 WHEN runs_on THEN 400 ELSE 300 END AS t_end, missed OR covered AS synthetic, false AS is_break
FROM judged
UNION ALL
SELECT stream_id, place - 1, NULL, 0.0, 0.0, 0, 0, t0 - {SILENCE_MS + FRAMES * FRAME_MS - 300}, t0, true, true FROM judged WHERE i % 33 = 23"""

_STREAM_SLOT = f"stream_id bigint, {SLOT_COLUMNS}"


def _rounded(slots: DataFrame) -> DataFrame:
    return slots.withColumn("share", F.round("share", 9)).withColumn("reliability", F.round("reliability", 9))


@query(_SHOWN_SLOTS)
def segment_exact(spark: SparkSession, d: str) -> DataFrame:
    """Slots of frames with all faults that the clock and the votes can mend: the oracle is what was shown."""
    return _rounded(in_order(shown_frames(spark, d), ["stream_id"], ["t"], Segmenting, _STREAM_SLOT))


def _corrupted_slots(spark: SparkSession, d: str) -> DataFrame:
    """Each message shown twice; every ninth symbol is not read in either showing, at different places, and every thirteenth is read wrongly in the first."""
    sent = P.transmissions(payloads(spark, d), KEYS).select(*KEYS, "n", F.posexplode("symbols").alias("i", "sym"))
    shown = sent.select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("pass_no"))
    i, no, symbol = F.col("i"), F.col("pass_no"), ~F.col("sym").isin(START, END)
    cls = F.when(symbol & ((i + 4 * no) % 9 == 5), None).when(symbol & (no == 0) & (i % 13 == 7), F.col("sym").bitwiseXOR(F.lit(33))).otherwise(F.col("sym"))
    return shown.select(*KEYS, (no * 1000 + i).alias("at"), cls.cast("int").alias("cls"), F.when(no == 0, 0.5).otherwise(0.9).alias("reliability"))


_MESSAGE = "src string, id bigint, turn bigint, text string, n int"
_SENT = sql("SELECT src, id, turn, text, CAST(strlen(text) + 3 + greatest(4, ceil((strlen(text) + 3) / 3.0)) AS INT) AS n FROM v_payload", "v_payload")


@query(_SENT)
def receive_exact(spark: SparkSession, d: str) -> DataFrame:
    """Messages read from two corrupted showings: the oracle is what was sent."""
    return in_order(_corrupted_slots(spark, d), KEYS, ["at"], Receiving, _MESSAGE)


#: Symbols of the tries that are made at a time, at most; a search makes at most n + 1 tries of a word of n symbols.
TRIED = 1 << 21


def steps_of_tries(lengths: np.ndarray) -> list[np.ndarray]:
    """Words by length, in steps whose tries have TRIED symbols together, or one word."""
    order = np.argsort(lengths, kind="stable")
    upto = np.cumsum((lengths[order] + 2) ** 2)
    return np.split(order, np.flatnonzero(np.diff(upto // TRIED)) + 1) if len(order) else []


def _searched(words: DataFrame, tries: Callable[..., np.ndarray], *more: str) -> DataFrame:
    """KEYS, text of rows (KEYS, word, more): of the first word that decodes, of those that ``tries`` makes of a row; null if none does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = [None] * batch.num_rows
            given = [batch.column(c) for c in ("word", *more)]
            for step in steps_of_tries(batch.column("word").value_lengths().to_numpy(zero_copy_only=False)):
                rows = [[array_of(v.values) if isinstance(v, pa.ListScalar) else v.as_py() for v in (c[k] for c in given)] for k in step.tolist()]
                for k, f in zip(step.tolist(), first_messages([tries(*x) for x in rows]), strict=True):
                    texts[k] = f[1].decode("utf-8", "replace") if f else None
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), pa.array(texts, pa.string())], names=[*KEYS, "text"])

    ship(words.sparkSession)
    return words.select(*KEYS, "word", *more).mapInArrow(run, "src string, id bigint, turn bigint, text string")


_TEXTS = sql("SELECT src, id, turn, text FROM v_payload", "v_payload")


@query(_TEXTS)
def gmd_decode(spark: SparkSession, d: str) -> DataFrame:
    """Words with more errors than parity alone can mend, of which the margins tell."""
    words = P.codewords(payloads(spark, d), KEYS)
    wrong = F.floor(F.col("nsym") * 3 / 5)
    bad = F.pmod(F.col("pos") + F.col("id"), F.col("k") + F.col("nsym")) < wrong
    rows = words.select(*KEYS, "pos", F.when(bad, F.col("sym").bitwiseXOR(F.lit(77))).otherwise(F.col("sym")).cast("int").alias("sym"), F.when(bad, 0.1).otherwise(0.9).alias("margin"))
    margin = F.transform(F.array_sort(F.collect_list(F.struct("pos", "margin"))), lambda x: x["margin"]).alias("margin")
    return _searched(rows.groupBy(*KEYS).agg(word_column(), margin), erasing_weakest, "margin")


@query(_TEXTS)
def shift_repair(spark: SparkSession, d: str) -> DataFrame:
    """Passes that lost a symbol, or got one twice."""
    lost = F.col("pos") == F.pmod("id", F.lit(5)) + 1
    words = P.codewords(payloads(spark, d), KEYS)
    less = words.where(~(lost & (F.col("turn") % 2 == 0))).withColumn("half", F.lit(0))
    more = words.where(lost & (F.col("turn") % 2 == 1)).withColumn("half", F.lit(1))
    rows = less.unionByName(more).select(*KEYS, "k", "nsym", (F.col("pos") * 2 + F.col("half")).alias("pos"), "sym")
    whole = rows.groupBy(*KEYS).agg(word_column(), F.first(F.col("k") + F.col("nsym")).alias("n"))
    return _searched(whole, one_mended, "n")


@query(
    codeword_oracle(
        "SELECT src, id, turn, CAST(max(n) - 1 AS INT) AS aligned, CAST(max(pos) FILTER (pos <= id % 5 + 1 AND (before IS NULL OR before <> sym)) AS INT) AS lost_at "
        "FROM (SELECT *, count(*) OVER (PARTITION BY src, id, turn) AS n, lag(sym) OVER (PARTITION BY src, id, turn ORDER BY pos) AS before FROM v_word) GROUP BY ALL"
    )
)
def align_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Passes that lost a symbol, aligned with the whole word: every symbol left finds a place, and the one left over is the lost one, or the first of its likes beside it."""
    words = P.codewords(payloads(spark, d), KEYS).groupBy(*KEYS).agg(word_column())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            aligned, lost = [], []
            for w, k in zip(batch.column("word"), batch.column("id").to_numpy(), strict=True):
                word = array_of(w.values)
                own, at = alignment(np.delete(word, k % 5 + 1), word)
                aligned.append(len(own))
                lost.append(int(np.setdiff1d(np.arange(len(word)), at)[0]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), pa.array(aligned, pa.int32()), pa.array(lost, pa.int32())], names=[*KEYS, "aligned", "lost_at"])

    ship(spark)
    return words.mapInArrow(run, "src string, id bigint, turn bigint, aligned int, lost_at int")


# --- the same as streams

#: Event time at which the shown streams begin: what is not after 1970 counts as late.
BEGINNING = 1_700_000_000_000


def landed(rows: DataFrame, fed: DataFrame, clock: str, folder: str, parts: list[DataFrame] = ()) -> DataFrame:
    """Runs a stream over what there is, then marks the end of the input and runs it on from its checkpoint, and reads what all runs wrote.

    rows: the stream's result; fed: the input it is made of, of which the mark is a last row, in the folder ``ends`` that
    ``to_the_end`` reads. parts: what comes into the folder ``feed``, a run after each.
    """

    def run() -> None:
        writer = rows.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
        writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    for part in parts:
        part.write.mode("append").parquet(f"{folder}/feed")
        run()
    if not parts:
        run()
    mark_of_the_end(fed, clock).write.mode("append").parquet(f"{folder}/ends")
    run()
    for used in ("made", "feed", "ends", "state"):
        remove(rows.sparkSession, f"{folder}/{used}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/out")


def _own_folder(spark: SparkSession, schema: StructType) -> str:
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for place in ("feed", "ends"):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{place}")
    return folder


def _fed(rows: DataFrame, clock: str) -> tuple[DataFrame, str, list[DataFrame]]:
    """A stream that reads what comes into a folder, and the rows in two parts, by time. What makes the rows is run once."""
    spark = rows.sparkSession
    folder = _own_folder(spark, rows.schema)
    rows.write.parquet(f"{folder}/made")
    made = spark.read.schema(rows.schema).parquet(f"{folder}/made")
    half = made.agg(F.timestamp_millis(((F.unix_millis(F.min(clock)) + F.unix_millis(F.max(clock))) / 2).cast("bigint")).alias("t")).first()["t"]
    early = F.col(clock) <= F.lit(half)
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/feed"), folder, [made.where(early), made.where(~early)]


@query(_SHOWN_SLOTS)
def stream_segment(spark: SparkSession, d: str) -> DataFrame:
    """The slots of an unbounded read of the same frames: in the order of event time, and whole, as the end closes what is open."""
    feed, folder, parts = _fed(shown_frames(spark, d).withColumn("at", F.timestamp_millis(F.col("t").cast("bigint") + BEGINNING)), "at")
    slots = in_event_time(to_the_end(feed, "at", f"{folder}/ends"), ["stream_id"], "at", ["t"], Segmenting, _STREAM_SLOT)
    return _rounded(landed(slots, feed, "at", folder, parts))


@query("SELECT epoch_us(ts) // 3600000000 AS hour, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Counts by hour of event time over an unbounded read. An hour is written, and leaves the state, when the watermark has passed it."""
    events = stream_table(spark, d, "events").select("event_type", "value", F.timestamp_millis(epoch_ms(F.col("ts")).cast("bigint")).alias("at"))
    folder = _own_folder(spark, events.schema)
    hours = to_the_end(events, "at", f"{folder}/ends").groupBy(F.window("at", "1 hour").alias("w"), "event_type")
    counted = hours.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("total"))
    rows = counted.select(F.floor(F.unix_seconds("w.start") / 3600).alias("hour"), "event_type", "n", "total")
    return landed(rows, events, "at", folder)


@query(_TEXTS)
def stream_receive(spark: SparkSession, d: str) -> DataFrame:
    """Messages read from a feed of slots, each as soon as it can be. A receiver that hears nothing more is closed, and goes."""
    feed, folder, parts = _fed(_corrupted_slots(spark, d).withColumn("time", F.timestamp_millis(F.col("at") * 1000 + BEGINNING)), "time")
    found = in_event_time(to_the_end(feed, "time", f"{folder}/ends"), KEYS, "time", ["at"], Receiving, _MESSAGE, idle_ms=3_600_000)
    return landed(found, feed, "time", folder, parts).select(*KEYS, "text")


@query(CAL_EXPECTED)
def stream_calibration(spark: SparkSession, d: str) -> DataFrame:
    """What each slot of a feed should show, as soon as the slots before it tell."""
    slots = S.indexed(S.slots(S.islands(observations(spark, d))))
    rows = slots.select("stream_id", "slot_no", F.col("index").cast("bigint").alias("i"), "cls", F.timestamp_millis("t_start").alias("at"))
    feed, folder, parts = _fed(rows, "at")
    found = in_event_time(to_the_end(feed, "at", f"{folder}/ends"), ["stream_id"], "at", ["i"], Calibration, "stream_id bigint, slot_no bigint, i bigint, got int, expected int", idle_ms=365 * 24 * 3_600_000)
    return landed(found, feed, "at", folder, parts)
