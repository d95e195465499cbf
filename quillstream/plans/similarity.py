"""Nearest neighbours among class embeddings, risk ranking, twins, reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table
from ..shipping import ship
from .quality import CLASSIFIER_SQL, TOP_SQL, predicted

#: Vectors of a block, at most, and at least where there are FEW blocks or less; queries that are multiplied at a time.
BLOCK, SMALL, FEW, STRIP = 16_384, 2048, 16, 256


def blocks_of(n: int, few: int) -> int:
    """Into how many blocks n vectors are dealt: as few as BLOCK allows, as each is sent once for every block of the other side; but enough to keep all cores busy."""
    return max(1, -(-n // BLOCK), min(few, -(-n // SMALL)))


def _best_of(a: pd.DataFrame, c: pd.DataFrame, excluded: str | None, both: bool) -> pd.DataFrame:
    """vec_id, near_id, likeness of the nearest in c of each row of a; both: and the nearest in a of each row of c."""
    a, c = a.sort_values("vec_id"), c.sort_values("vec_id")
    x, y = (np.stack(f.v.to_numpy()).astype(float) for f in (a, c))
    x, y = (m / (np.sqrt((m * m).sum(1, keepdims=True)) + 1e-6) for m in (x, y))
    ids, others = a.vec_id.to_numpy(), c.vec_id.to_numpy()
    groups = (a[excluded].to_numpy(), c[excluded].to_numpy()) if excluded else None
    none = -2e6
    top, near = np.full((2, max(len(a), len(c))), none), np.zeros((2, max(len(a), len(c))), np.int64)
    for k in range(0, len(a), STRIP):
        own = slice(k, min(k + STRIP, len(a)))
        s = x[own] @ y.T
        np.rint(np.multiply(s, 1e6, out=s), out=s)
        s[ids[own, None] == others[None, :]] = none
        if groups:
            s[groups[0][own, None] == groups[1][None, :]] = none
        at = s.argmax(1)
        top[0, own], near[0, own] = s[np.arange(len(at)), at], others[at]
        if both:
            at = s.argmax(0)
            value = s[at, np.arange(len(at))]
            better = np.flatnonzero(value > top[1, : len(c)])  # of equal ones the first, and so the least id, stays
            top[1, better], near[1, better] = value[better], ids[own][at[better]]
    sides = [(ids, top[0, : len(a)], near[0, : len(a)]), (others, top[1, : len(c)], near[1, : len(c)])]
    found = [(i[t > none], n[t > none], t[t > none] / 1e6) for i, t, n in sides[: 1 + both]]
    return pd.DataFrame({name: np.concatenate(v) for name, v in zip(("vec_id", "near_id", "likeness"), zip(*found, strict=True), strict=True)})


def nearest(queries: DataFrame, base: DataFrame, excluded: str | None = None) -> DataFrame:
    """vec_id, near_id, likeness: for each query its nearest other vector by cosine, exactly; the least id on ties.

    Both sides are dealt into blocks by a hash of the id; every pair of blocks is one matrix product, taken strip by strip,
    so nothing is broadcast and no pair of rows is ever a row. Where a table is compared with itself, two blocks meet once, for
    both. Each task gives one candidate per query and the best of them is kept. What is sent is n * n / BLOCK vectors, as they are
    stored; a block bounds what a task holds. excluded: a column of both sides whose equal values are not compared.
    """
    ship(queries.sparkSession)
    group = [excluded] if excluded else []
    itself = queries is base
    n = base.count()
    g = blocks_of(n, FEW if itself else 4 * FEW)
    held = lambda df, m: df.select(F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int").alias("b"), "vec_id", *group, F.col("embedding").alias("v"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    if itself:
        pairs = g * (g + 1) // 2
        met = held(base, g).withColumn("x", every(g)).withColumn("i", F.least("b", "x")).withColumn("j", F.greatest("b", "x"))
        dealt = met.withColumn("side", (F.col("b") != F.col("i")).cast("int")).drop("b", "x")
    else:
        h = blocks_of(queries.count(), 1)
        pairs = g * h
        q = held(queries, h).withColumn("side", F.lit(0)).withColumn("i", F.col("b")).withColumn("j", every(g))
        dealt = q.unionByName(held(base, g).withColumn("side", F.lit(1)).withColumn("j", F.col("b")).withColumn("i", every(h))).drop("b")

    def best(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        one = itself and key[0] == key[1]
        a, c = frame[frame.side == 0], frame[frame.side == (0 if one else 1)]
        if not len(a) or not len(c):
            return pd.DataFrame({"vec_id": [], "near_id": [], "likeness": []}).astype({"vec_id": "int64", "near_id": "int64"})
        return _best_of(a, c, excluded, itself and not one)

    found = dealt.repartition(min(pairs, 400), "i", "j").groupBy("i", "j").applyInPandas(best, "vec_id bigint, near_id bigint, likeness double")
    order = F.struct("likeness", (-F.col("near_id")).alias("o"))
    return found.groupBy("vec_id").agg(F.max(order).alias("x")).select("vec_id", (-F.col("x.o")).alias("near_id"), F.col("x.likeness").alias("likeness"))


_UNIT = "v_unit AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) + 1e-6)) AS u FROM embeddings)"
_NEAR = "SELECT vec_id, near_id, likeness FROM (SELECT a.vec_id, b.vec_id AS near_id, round(list_dot_product(a.u, b.u), 6) AS likeness, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.u, b.u), 6) DESC, b.vec_id) AS r FROM v_unit a JOIN v_unit b ON {on}) WHERE r = 1"


@query(f"WITH {_UNIT} {_NEAR.format(on='a.vec_id <> b.vec_id')}")
def nn_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return nearest(e, e)


@query(f"WITH {_UNIT} {_NEAR.format(on='a.vec_id % 20 = 0 AND a.label <> b.label')}")
def nn_remaining(spark: SparkSession, d: str) -> DataFrame:
    """Candidates against all vectors but those of the class they would replace."""
    e = table(spark, d, "embeddings")
    return nearest(e.where("vec_id % 20 = 0"), e, "label")


# --- the classes of a classifier, ranked: how they are read, how like others they are, and what is wrong with them

#: Leading dimensions of a mean that stand for a thumbnail.
THUMB = 16

_CLASS = f"""{TOP_SQL}, {CLASSIFIER_SQL},
v_read AS (SELECT label AS cls, count(*) AS n, round(avg((pred = label)::INT), 6) AS hit, round(avg((ok AND pred <> 9 AND pred = label)::INT), 6) AS accepted_ok, round(avg((ok AND pred <> 9 AND pred <> label)::INT), 6) AS dangerous,
    round(coalesce(avg(p1 - p2) FILTER (pred = label), 0), 6) AS margin FROM v_pred WHERE label <> 9 GROUP BY label),
v_confused AS (SELECT label AS cls, list(pred || ':' || n ORDER BY r) AS confusions FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, seen) AS r FROM (SELECT label, pred, count(*) AS n, min(vec_id) AS seen FROM v_pred WHERE pred <> label AND label <> 9 GROUP BY ALL)) WHERE r <= 3 GROUP BY label),
v_mean AS (SELECT label AS cls, i, avg(embedding[i + 1]::DOUBLE) AS m FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings WHERE label <> 9) GROUP BY ALL),
v_size AS (SELECT cls, sqrt(sum(m * m)) + 1e-6 AS size, sqrt(sum(m * m) FILTER (i < {THUMB})) + 1e-6 AS thumb, round(100 * stddev_pop(m), 6) AS texture FROM v_mean GROUP BY cls),
v_like AS (SELECT a.cls, b.cls AS other, round(sum(a.m * b.m) / (x.size * y.size), 6) AS s, round(sum(a.m * b.m) FILTER (a.i < {THUMB}) / (x.thumb * y.thumb), 6) AS t
    FROM v_mean a JOIN v_mean b ON a.i = b.i AND a.cls <> b.cls JOIN v_size x ON x.cls = a.cls JOIN v_size y ON y.cls = b.cls GROUP BY a.cls, b.cls, x.size, y.size, x.thumb, y.thumb),
v_near AS (SELECT cls, max(s) AS like_model, min(other) FILTER (r = 1) AS near_model, max(t) AS like_thumb, min(other) FILTER (q = 1) AS near_thumb
    FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY s DESC, other) AS r, row_number() OVER (PARTITION BY cls ORDER BY t DESC, other) AS q FROM v_like) GROUP BY cls),
v_metric AS (SELECT cls, n, hit, accepted_ok, dangerous, margin, coalesce(confusions, []) AS confusions, texture, like_model, near_model, like_thumb, near_thumb FROM v_read JOIN v_size USING (cls) JOIN v_near USING (cls) LEFT JOIN v_confused USING (cls))"""
_RISK = """v_risk AS (SELECT *, round((1 - accepted_ok) + 5 * dangerous + greatest(0, (6 - texture) / 20) + greatest(0, like_model - 0.75) + greatest(0, like_thumb - 0.9), 6) AS risk,
    accepted_ok < 0.92 OR dangerous > 0 AS bad_read, like_model > 0.85 OR like_thumb > 0.9 AS duplicate FROM v_metric),
v_level AS (SELECT *, CASE WHEN bad_read OR duplicate THEN 'replace' WHEN accepted_ok < 0.95 THEN 'optional' ELSE 'fine' END AS level,
    list_filter([CASE WHEN accepted_ok < 0.92 THEN 'seldom read' END, CASE WHEN dangerous > 0 THEN 'taken for another' END, CASE WHEN texture < 4 THEN 'little texture' END,
        CASE WHEN like_model > 0.85 THEN 'very like ' || near_model WHEN like_thumb > 0.9 THEN 'nearly equal to ' || near_thumb END], lambda x: x IS NOT NULL) AS reasons FROM v_risk)"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """How each class is read, what it is taken for, and its nearest other class by all of its mean vector and by a part of it.

    Class 9 plays the class of nothing: it is not ranked, and taking something for it is no danger.
    Means are one row for each class and dimension, so what is joined with itself is bounded by the number of classes.
    """
    c = F.col
    rows = predicted(spark, d).where("label <> 9")
    hit, ok = c("pred") == c("label"), c("ok") & (c("pred") != 9)
    mean = lambda x: F.avg(x.cast("int"))
    read = rows.groupBy(c("label").alias("cls")).agg(
        F.count("*").alias("n"),
        F.round(mean(hit), 6).alias("hit"),
        F.round(mean(ok & hit), 6).alias("accepted_ok"),
        F.round(mean(ok & ~hit), 6).alias("dangerous"),
        F.round(F.coalesce(F.avg(F.when(hit, c("p1") - c("p2"))), F.lit(0.0)), 6).alias("margin"),
    )
    wrong = rows.where(~hit).groupBy("label", "pred").agg(F.count("*").alias("n"), F.min("vec_id").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(c("n").desc(), "seen"))
    top = wrong.withColumn("r", rank).where("r <= 3").groupBy(c("label").alias("cls")).agg(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", c("pred").cast("string"), c("n").cast("string")).alias("x")))).alias("l"))
    top = top.select("cls", F.transform("l", lambda x: x["x"]).alias("confusions"))
    means = table(spark, d, "embeddings").where("label <> 9").select(c("label").alias("cls"), F.posexplode("embedding").alias("i", "x")).groupBy("cls", "i").agg(F.avg(c("x").cast("double")).alias("m"))
    square = c("m") * c("m")
    size = means.groupBy("cls").agg((F.sqrt(F.sum(square)) + 1e-6).alias("size"), (F.sqrt(F.sum(F.when(c("i") < THUMB, square))) + 1e-6).alias("thumb"), F.round(100 * F.stddev_pop("m"), 6).alias("texture"))
    sized = means.join(size.drop("texture"), "cls")
    other = sized.toDF("other", "i", "m2", "size2", "thumb2")
    product = c("m") * c("m2")
    like = sized.join(other, "i").where("cls <> other").groupBy("cls", "other").agg(
        F.round(F.sum(product) / (F.first("size") * F.first("size2")), 6).alias("s"),
        F.round(F.sum(F.when(c("i") < THUMB, product)) / (F.first("thumb") * F.first("thumb2")), 6).alias("t"),
    )
    best = lambda x: F.max(F.struct(x, (-c("other")).alias("o")))
    near = like.groupBy("cls").agg(best("s").alias("a"), best("t").alias("b")).select("cls", c("a.s").alias("like_model"), (-c("a.o")).alias("near_model"), c("b.t").alias("like_thumb"), (-c("b.o")).alias("near_thumb"))
    out = read.join(size.select("cls", "texture"), "cls").join(near, "cls").join(top, "cls", "left")
    return out.withColumn("confusions", F.coalesce("confusions", F.array().cast("array<string>")))


@query(f"WITH {_CLASS} SELECT * FROM v_metric")
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d)


def levels(rows: DataFrame) -> DataFrame:
    """Risk, level and reasons of each class."""
    c = F.col
    over = lambda x: F.greatest(F.lit(0.0), x)
    risk = (1 - c("accepted_ok")) + 5 * c("dangerous") + over((6 - c("texture")) / 20) + over(c("like_model") - 0.75) + over(c("like_thumb") - 0.9)
    bad_read = (c("accepted_ok") < 0.92) | (c("dangerous") > 0)
    duplicate = (c("like_model") > 0.85) | (c("like_thumb") > 0.9)
    level = F.when(bad_read | duplicate, "replace").when(c("accepted_ok") < 0.95, "optional").otherwise("fine")
    like: Column = F.when(c("like_model") > 0.85, F.concat(F.lit("very like "), c("near_model").cast("string"))).when(c("like_thumb") > 0.9, F.concat(F.lit("nearly equal to "), c("near_thumb").cast("string")))
    reasons = F.array_compact(F.array(F.when(c("accepted_ok") < 0.92, "seldom read"), F.when(c("dangerous") > 0, "taken for another"), F.when(c("texture") < 4, "little texture"), like))
    return rows.withColumn("risk", F.round(risk, 6)).withColumn("bad_read", bad_read).withColumn("duplicate", duplicate).withColumn("level", level).withColumn("reasons", reasons)


@query(f"WITH {_CLASS}, {_RISK} SELECT cls, risk, level, reasons FROM v_level")
def risk_levels(spark: SparkSession, d: str) -> DataFrame:
    return levels(metrics(spark, d)).select("cls", "risk", "level", "reasons")


@query(f"WITH {_CLASS}, {_RISK} SELECT cls, risk, level FROM v_level ORDER BY risk DESC, cls LIMIT 25")
def risk_rank(spark: SparkSession, d: str) -> DataFrame:
    return levels(metrics(spark, d)).select("cls", "risk", "level").orderBy(F.col("risk").desc(), "cls").limit(25)


_TWIN = """v_only AS (SELECT *, level = 'replace' AND duplicate AND NOT bad_read AND texture >= 4 AS only_duplicate, CASE WHEN like_thumb > 0.9 THEN near_thumb ELSE near_model END AS twin FROM v_level)
SELECT a.cls, CASE WHEN a.only_duplicate AND b.level = 'replace' AND (b.risk > a.risk OR (b.risk = a.risk AND b.cls < a.cls)) THEN 'optional' ELSE a.level END AS level, b.cls AS twin FROM v_only a LEFT JOIN v_only b ON b.cls = a.twin"""


@query(f"WITH {_CLASS}, {_RISK}, {_TWIN}")
def duplicate_twin(spark: SparkSession, d: str) -> DataFrame:
    """Of two that are only each other's duplicates, the one of less risk may stay."""
    c = F.col
    rows = levels(metrics(spark, d))
    only = (c("level") == "replace") & c("duplicate") & ~c("bad_read") & (c("texture") >= 4)
    a = rows.withColumn("only_duplicate", only).withColumn("twin", F.when(c("like_thumb") > 0.9, c("near_thumb")).otherwise(c("near_model")))
    b = rows.select(c("cls").alias("twin_cls"), c("level").alias("twin_level"), c("risk").alias("twin_risk"))
    stays = c("only_duplicate") & (c("twin_level") == "replace") & ((c("twin_risk") > c("risk")) | ((c("twin_risk") == c("risk")) & (c("twin_cls") < c("cls"))))
    return a.join(b, c("twin") == c("twin_cls"), "left").select("cls", F.when(F.coalesce(stays, F.lit(False)), "optional").otherwise(c("level")).alias("level"), c("twin_cls").alias("twin"))


@query(f"WITH {_CLASS}, {_RISK} SELECT level, count(*) AS classes, count(*) FILTER (accepted_ok >= 0.95 AND dangerous = 0) AS sound, round(avg(accepted_ok), 6) AS mean_ok FROM v_level GROUP BY level")
def risk_summary(spark: SparkSession, d: str) -> DataFrame:
    return levels(metrics(spark, d)).groupBy("level").agg(F.count("*").alias("classes"), F.count_if((F.col("accepted_ok") >= 0.95) & (F.col("dangerous") == 0)).alias("sound"), F.round(F.avg("accepted_ok"), 6).alias("mean_ok"))


@query(f"WITH {_CLASS}, {_RISK} SELECT level, '| ' || cls || ' | ' || CAST(CAST(round(accepted_ok * 1000) AS BIGINT) AS VARCHAR) || ' | ' || array_to_string(reasons, '; ') || ' |' AS line FROM v_level WHERE level <> 'fine'")
def risk_report(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a Markdown table, by level; accuracy in tenths of a percent."""
    cells = [F.lit(""), F.col("cls").cast("string"), F.round(F.col("accepted_ok") * 1000).cast("bigint").cast("string"), F.array_join("reasons", "; ")]
    line = F.concat(F.ltrim(F.concat_ws(" | ", *cells)), F.lit(" |"))
    return levels(metrics(spark, d)).where("level <> 'fine'").select("level", line.alias("line"))
