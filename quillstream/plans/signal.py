"""Observations, slots and passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import END, NONE, START
from ..operators import passes as P
from ..operators import slots as S
from ..registry import query, table
from ..sources.views import epoch_ms, observations, sql

#: The driver's events are hours apart, so the time constants of frames are scaled to them (ms).
TICK_MS = 3_600_000
PERIOD_MS = 26_474_000
LONGEST_MS = 200_000_000
USUAL_MS = 4_000_000


@query(f"SELECT CAST(floor(epoch_us(ts) // 1000 / {TICK_MS}) AS BIGINT) AS tick, max(event_id) AS last_event, min(event_id) AS first_event, count(*) - 1 AS dropped FROM events GROUP BY ALL")
def src_tick_sample(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each tick, as when frames that arrive during processing are dropped."""
    rows = table(spark, d, "events").select("event_id", F.floor(epoch_ms(F.col("ts")) / TICK_MS).alias("tick"))
    return rows.groupBy("tick").agg(F.max("event_id").alias("last_event"), F.min("event_id").alias("first_event"), (F.count("*") - 1).alias("dropped"))


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) WHERE i % 3 = 0")
def src_step_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every third row of each stream."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, d, "events").select("event_id", "user_id", i.alias("i")).where("i % 3 = 0").drop("i")


@query(sql("SELECT stream_id, seq, round(t_ms / 1000.0, 1) AS t_s, gap, cls, round(w / 100.0, 1) AS p FROM v_obs", "v_obs"))
def slim_projection(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    return o.select("stream_id", "seq", F.round(F.col("t_ms") / 1000.0, 1).alias("t_s"), "gap", "cls", F.round(F.col("w") / 100.0, 1).alias("p"))


@query(
    sql(
        "SELECT cls, n, CASE WHEN cls IS NULL THEN '—' WHEN cls = 256 THEN 'START' WHEN cls = 257 THEN 'END' WHEN cls = 258 THEN 'none' WHEN cls BETWEEN 32 AND 126 THEN cls::VARCHAR || ' ' || chr(cls) ELSE cls::VARCHAR END AS label, "
        "coalesce(round(100.0 * gaps / n, 1)::VARCHAR || '%', '—') AS gap_share FROM (SELECT cls, count(*) AS n, CAST(sum(gap::INT) AS BIGINT) AS gaps FROM v_obs GROUP BY cls)",
        "v_obs",
    )
)
def class_label(spark: SparkSession, d: str) -> DataFrame:
    counted = observations(spark, d).groupBy("cls").agg(F.count("*").alias("n"), F.sum(F.col("gap").cast("int")).alias("gaps"))
    cls = F.col("cls")
    name = F.when(cls.isNull(), "—").when(cls == START, "START").when(cls == END, "END").when(cls == NONE, "none").when(cls.between(32, 126), F.concat_ws(" ", cls.cast("string"), F.char(cls))).otherwise(cls.cast("string"))
    share = F.concat(F.round(100.0 * F.col("gaps") / F.col("n"), 1).cast("string"), F.lit("%"))
    return counted.select("cls", "n", name.alias("label"), F.coalesce(share, F.lit("—")).alias("gap_share"))


@query(sql("SELECT stream_id, slot_no, count(*) AS frames, min(t_ms) AS t_start, max(t_ms) AS t_end FROM v_islands GROUP BY ALL", "v_islands"))
def slots_islands(spark: SparkSession, d: str) -> DataFrame:
    return S.islands(observations(spark, d)).groupBy(*S.SLOT).agg(F.count("*").alias("frames"), F.min("t_ms").alias("t_start"), F.max("t_ms").alias("t_end"))


@query(sql("SELECT stream_id, slot_no, cls, weight, n, first_seq FROM v_votes", "v_votes"))
def slot_ballots(spark: SparkSession, d: str) -> DataFrame:
    return S.votes(S.islands(observations(spark, d)))


def _slots(spark: SparkSession, d: str) -> DataFrame:
    return S.slots(S.islands(observations(spark, d)))


@query(sql("SELECT stream_id, slot_no, frames, t_start, t_end, accepted, cls FROM v_slots", "v_slots"))
def slot_vote(spark: SparkSession, d: str) -> DataFrame:
    return _slots(spark, d).select(*S.SLOT, "frames", "t_start", "t_end", "accepted", "cls")


@query(sql("SELECT stream_id, slot_no, cls, round(share, 9) AS share, round(reliability, 9) AS reliability FROM v_slots", "v_slots"))
def slot_reliability(spark: SparkSession, d: str) -> DataFrame:
    return _slots(spark, d).select(*S.SLOT, "cls", F.round("share", 9).alias("share"), F.round("reliability", 9).alias("reliability"))


@query(sql("SELECT stream_id, slot_no, winner, winner_frames, winner IN (256, 257) AND winner_frames < 2 AS dropped FROM v_ballots WHERE winner IN (256, 257)", "v_ballots"))
def slot_control_guard(spark: SparkSession, d: str) -> DataFrame:
    """Control symbols that win a slot, and whether a single frame is too little for them."""
    ballot = F.when(F.col("weight") > 0, F.struct("weight", (-F.col("first_seq")).alias("o"), "cls", "n"))
    best = S.votes(S.islands(observations(spark, d))).groupBy(*S.SLOT).agg(F.max(ballot).alias("b"))
    won = best.where(F.col("b.cls").isin(START, END))
    return won.select(*S.SLOT, F.col("b.cls").alias("winner"), F.col("b.n").alias("winner_frames"), (F.col("b.n") < 2).alias("dropped"))


@query(
    sql(
        "SELECT stream_id, seq, dt, coalesce(quantile_cont(dt, 0.5) OVER (PARTITION BY stream_id ORDER BY t_ms, seq ROWS 30 PRECEDING), 33) AS frame_dt FROM "
        f"(SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY stream_id ORDER BY t_ms, seq) AS dt FROM v_obs) WHERE dt > 0 AND dt < {LONGEST_MS}",
        "v_obs",
    )
)
def frame_dt_median(spark: SparkSession, d: str) -> DataFrame:
    return S.frame_intervals(observations(spark, d), LONGEST_MS)


@query(
    sql(
        "SELECT stream_id, slot_no, delta, CASE WHEN count(delta) OVER w >= 5 THEN quantile_cont(delta, 0.5) OVER w END AS period FROM "
        "(SELECT *, t_start - lag(t_start) OVER (PARTITION BY stream_id ORDER BY slot_no) AS delta FROM v_slots) WHERE delta > 0 WINDOW w AS (PARTITION BY stream_id ORDER BY slot_no ROWS 20 PRECEDING)",
        "v_slots",
    )
)
def slot_period_median(spark: SparkSession, d: str) -> DataFrame:
    return S.periods(_slots(spark, d))


@query(sql("SELECT stream_id, slot_no, cls, row_number() OVER (PARTITION BY stream_id ORDER BY slot_no) - 1 AS index FROM v_slots", "v_slots"))
def slot_index(spark: SparkSession, d: str) -> DataFrame:
    return S.indexed(_slots(spark, d)).select(*S.SLOT, "cls", F.col("index").cast("bigint").alias("index"))


@query(
    sql(
        "SELECT stream_id, slot_no, prev_end AS break_start, t_start AS break_end FROM (SELECT *, lag(t_start) OVER o AS prev_start, lag(t_end) OVER o AS prev_end FROM v_slots WINDOW o AS (PARTITION BY stream_id ORDER BY slot_no)) "
        f"WHERE t_start - prev_start > 6 * {PERIOD_MS}",
        "v_slots",
    )
)
def slot_break(spark: SparkSession, d: str) -> DataFrame:
    return S.breaks(_slots(spark, d), PERIOD_MS)


@query(
    sql(
        f"SELECT stream_id, slot_no, i, prev_start + i * {PERIOD_MS} AS t_start, CASE WHEN i <= copies THEN prev_cls END AS cls, CASE WHEN i <= copies THEN round(0.6 * prev_reliability, 9) ELSE 0.0 END AS reliability FROM "
        f"(SELECT *, unnest(range(1, missing + 1)) AS i FROM (SELECT *, CAST(round((t_start - prev_start) / {PERIOD_MS}) AS BIGINT) - 1 AS missing, CASE WHEN prev_cls IS NULL THEN 0 ELSE round((prev_end - prev_start - {USUAL_MS}) / {PERIOD_MS}) END AS copies FROM "
        "(SELECT *, lag(t_start) OVER o AS prev_start, lag(t_end) OVER o AS prev_end, lag(cls) OVER o AS prev_cls, lag(reliability) OVER o AS prev_reliability FROM v_slots WINDOW o AS (PARTITION BY stream_id ORDER BY slot_no))) "
        f"WHERE missing >= 1 AND t_start - prev_start <= 6 * {PERIOD_MS})",
        "v_slots",
    )
)
def slot_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return S.fillers(_slots(spark, d), PERIOD_MS, USUAL_MS)


def _passes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    syms = P.symbols(_slots(spark, d))
    return P.passes(syms), syms


@query(sql("SELECT stream_id, pass_no, length, has_start, after_end, has_end, is_current FROM v_passes", "v_passes"))
def pass_sessionize(spark: SparkSession, d: str) -> DataFrame:
    return _passes(spark, d)[0]


@query(sql("SELECT stream_id, pass_no, i, sym, round(rel, 9) AS rel FROM v_symbols", "v_symbols"))
def pass_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _passes(spark, d)[1].select("stream_id", "pass_no", "i", "sym", F.round("rel", 9).alias("rel"))


@query(sql("SELECT stream_id, pass_no, length FROM v_passes WHERE NOT is_current AND (has_start OR has_end)", "v_passes"))
def pass_anchored(spark: SparkSession, d: str) -> DataFrame:
    return P.anchored(_passes(spark, d)[0]).select("stream_id", "pass_no", "length")


@query(sql("SELECT stream_id, pass_no, length FROM v_used WHERE NOT is_current", "v_used"))
def pass_last12(spark: SparkSession, d: str) -> DataFrame:
    return P.last_passes(_passes(spark, d)[0]).select("stream_id", "pass_no", "length")


@query(sql("SELECT stream_id, pass_no, length, is_current FROM v_used", "v_used"))
def pass_union_current(spark: SparkSession, d: str) -> DataFrame:
    return P.used(_passes(spark, d)[0]).select("stream_id", "pass_no", "length", "is_current")


@query(sql("SELECT s.stream_id, s.pass_no, count(*) AS symbols, count(*) FILTER (sym IS NULL) AS erased FROM v_symbols s GROUP BY ALL", "v_symbols"))
def pass_erasures(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and erasures of each pass, as a status line shows them."""
    return _passes(spark, d)[1].groupBy("stream_id", "pass_no").agg(F.count("*").alias("symbols"), F.count_if(F.col("sym").isNull()).alias("erased"))


def _decoding(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, syms = _passes(spark, d)
    rows = P.used(rows)
    return rows, syms, P.candidate_lengths(rows, syms)


@query(sql("SELECT stream_id, n, support, seen FROM v_support", "v_support"))
def candidate_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _decoding(spark, d)[2]


@query(sql("SELECT * FROM (SELECT stream_id, n, support, row_number() OVER (PARTITION BY stream_id ORDER BY support DESC, seen) AS rank FROM v_support) WHERE rank <= 4", "v_support"))
def candidate_top4(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.col("support").desc(), "seen"))
    return _decoding(spark, d)[2].withColumn("rank", rank.cast("bigint")).where("rank <= 4").drop("seen")


@query(sql("SELECT stream_id, n FROM v_expected", "v_expected"))
def expected_length(spark: SparkSession, d: str) -> DataFrame:
    return P.expected_length(_decoding(spark, d)[2])


def _cast(spark: SparkSession, d: str) -> DataFrame:
    rows, syms, support = _decoding(spark, d)
    return P.position_votes(rows, syms, P.expected_length(support))


@query(sql("SELECT stream_id, n, pos, sym, weight, first_pass FROM v_cast", "v_cast"))
def position_votes(spark: SparkSession, d: str) -> DataFrame:
    return _cast(spark, d)


_MARGIN = "SELECT stream_id, n, pos, sym, round(weight - next, 6) AS margin FROM (SELECT *, row_number() OVER o AS r, lead(weight, 1, 0) OVER o AS next FROM v_cast WINDOW o AS (PARTITION BY stream_id, n, pos ORDER BY weight DESC, first_pass)) WHERE r = 1"


@query(sql(_MARGIN, "v_cast"))
def position_margin(spark: SparkSession, d: str) -> DataFrame:
    return P.margins(_cast(spark, d))


@query(sql(f"SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY margin, pos) AS rank FROM ({_MARGIN})", "v_cast"))
def gmd_order(spark: SparkSession, d: str) -> DataFrame:
    return P.least_reliable_first(P.margins(_cast(spark, d))).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "SELECT user_id, event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) / count(value) OVER w AS running_mean, max(value) OVER w AS running_best "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
)
def running_best(spark: SparkSession, d: str) -> DataFrame:
    """Best value so far and mean so far (in hundredths) of each stream."""
    upto = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    hundredths = F.sum(F.round(F.col("value") * 100).cast("bigint")).over(upto)
    return table(spark, d, "events").select("user_id", "event_id", (hundredths / F.count("value").over(upto)).alias("running_mean"), F.max("value").over(upto).alias("running_best"))


@query(
    "SELECT user_id, round(list_reduce(list_prepend(values[1], values[2:]), lambda a, x: 0.9 * a + 0.1 * x), 6) AS ewma, n FROM (SELECT user_id, list(value ORDER BY event_id) AS values, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY user_id)"
)
def ewma_perf(spark: SparkSession, d: str) -> DataFrame:
    """Exponential mean with a tenth of the weight on each new value, in closed form: no list of a stream is built."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, d, "events").where("value IS NOT NULL").select("user_id", "value", F.row_number().over(order).alias("i"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    weight = F.when(F.col("i") == 1, 1.0).otherwise(0.1) * F.pow(F.lit(0.9), F.col("n") - F.col("i"))
    return rows.groupBy("user_id").agg(F.round(F.sum(F.col("value") * weight), 6).alias("ewma"), F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    """Rows where the state differs from the one before: what a display redraws."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", "event_type", before.alias("before")).where("before IS NULL OR before <> event_type").drop("before")
