"""Timelines and noisy streams made by arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SPEEDS
from ..registry import query

SYMBOL_MS, GAP_MS = SPEEDS["normal"]
SLOT_MS = SYMBOL_MS + GAP_MS
SYMBOLS = 14
FRAMES = 20_000


def state_at(ms: Column, symbols: int = SYMBOLS) -> list[Column]:
    """slot, pass, index and whether the instant falls in a gap."""
    slot = F.floor(ms / SLOT_MS)
    return [slot.alias("slot"), F.floor(slot / symbols).alias("pass_no"), F.pmod(slot, F.lit(symbols)).alias("index"), (F.pmod(ms, F.lit(SLOT_MS)) >= SYMBOL_MS).alias("gap")]


@query(f"SELECT id AS frame, id * 50 // {SLOT_MS} AS slot, id * 50 // {SLOT_MS} // {SYMBOLS} AS pass_no, id * 50 // {SLOT_MS} % {SYMBOLS} AS index, id * 50 % {SLOT_MS} >= {SYMBOL_MS} AS gap FROM (SELECT unnest(range({FRAMES})) AS id)")
def timeline_state(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(FRAMES).select(F.col("id").alias("frame"), *state_at(F.col("id") * 50))


@query(
    f"SELECT frame, state, CAST(sum(25) AS BIGINT) AS percent, count(*) OVER (PARTITION BY frame) > 1 AS mixed FROM (SELECT id AS frame, CASE WHEN ms % {SLOT_MS} >= {SYMBOL_MS} THEN -1 ELSE ms // {SLOT_MS} % {SYMBOLS} END AS state "
    f"FROM (SELECT id, id * 50 + q * 9 AS ms FROM (SELECT unnest(range({FRAMES})) AS id), (SELECT unnest(range(4)) AS q))) GROUP BY frame, state"
)
def exposure_mix(spark: SparkSession, d: str) -> DataFrame:
    """What four instants of each exposure show, with their weights; the frame is mixed if they differ."""
    ms = F.col("id") * 50 + F.col("q") * 9
    shown = spark.range(FRAMES).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q")).select(F.col("id").alias("frame"), F.when(F.pmod(ms, F.lit(SLOT_MS)) >= SYMBOL_MS, F.lit(-1)).otherwise(F.pmod(F.floor(ms / SLOT_MS), F.lit(SYMBOLS))).cast("bigint").alias("state"))
    parts = shown.groupBy("frame", "state").agg(F.sum(F.lit(25)).alias("percent"))
    many = shown.groupBy("frame").agg((F.min("state") != F.max("state")).alias("mixed"))
    return parts.join(many, "frame")


def noise(key: Column, salt: int) -> Column:
    """0 to 9999 from an arithmetic congruence that any engine computes alike."""
    return F.pmod(F.floor(F.pmod((key + salt) * 1_103_515_245 + 12_345, F.lit(2_147_483_648)) / 65_536) * 7919 + key * 31, F.lit(10_000))


_NOISE = "((((id + {s}) * 1103515245 + 12345) % 2147483648 // 65536) * 7919 + id * 31) % 10000"


@query(
    f"SELECT id AS seq, id * 50 AS t_ms, gap AND {_NOISE.format(s=1)} >= 800 AS gap, CASE WHEN gap THEN NULL WHEN {_NOISE.format(s=2)} < 3000 THEN NULL WHEN {_NOISE.format(s=3)} < 500 THEN 258 WHEN {_NOISE.format(s=4)} < 600 THEN (sym + 1 + {_NOISE.format(s=5)}) % 256 ELSE sym END AS cls "
    f"FROM (SELECT id, id * 50 % {SLOT_MS} >= {SYMBOL_MS} AS gap, CASE id * 50 // {SLOT_MS} % {SYMBOLS} WHEN 0 THEN 256 WHEN {SYMBOLS - 1} THEN 257 ELSE id * 50 // {SLOT_MS} % {SYMBOLS} * 10 END AS sym FROM (SELECT unnest(range({FRAMES})) AS id))"
)
def sim_frames(spark: SparkSession, d: str) -> DataFrame:
    """A stream with uncertain, wrong and empty frames and missed gaps; the noise is arithmetic."""
    key = F.col("id")
    _, _, index, gap = state_at(key * 50)
    rows = spark.range(FRAMES).select("id", index, gap)
    i = F.col("index")
    sym = F.when(i == 0, 256).when(i == SYMBOLS - 1, 257).otherwise(i * 10)
    cls = F.when(F.col("gap"), None).when(noise(key, 2) < 3000, None).when(noise(key, 3) < 500, 258).when(noise(key, 4) < 600, F.pmod(sym + 1 + noise(key, 5), F.lit(256))).otherwise(sym)
    return rows.select(key.alias("seq"), (key * 50).alias("t_ms"), (F.col("gap") & (noise(key, 1) >= 800)).alias("gap"), cls.cast("bigint").alias("cls"))


@query("SELECT id AS step, CASE WHEN id < 500 THEN id / 500 ELSE round(0.5 * (1 + cos(pi() * (id - 500) / 4500)), 9) END AS factor FROM (SELECT unnest(range(5001)) AS id)")
def learning_rate(spark: SparkSession, d: str) -> DataFrame:
    """Warm-up, then a half cosine."""
    i = F.col("id")
    return spark.range(5001).select(i.alias("step"), F.when(i < 500, i / 500).otherwise(F.round(0.5 * (1 + F.cos(F.pi() * (i - 500) / 4500)), 9)).alias("factor"))


@query(f"SELECT n, CAST(floor((n + 2) * {SLOT_MS} / 1000.0 + 0.5) AS BIGINT) AS seconds FROM (SELECT unnest(range(1, 256)) AS n)")
def pass_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Time to show a codeword of n symbols with its controls once."""
    return spark.range(1, 256).select(F.col("id").alias("n"), F.floor((F.col("id") + 2) * SLOT_MS / 1000.0 + 0.5).alias("seconds"))
