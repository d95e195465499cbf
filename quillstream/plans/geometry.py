"""Pixels, masks and shapes on grids made by arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import FRAME_BORDER, FRAME_OUTER, FRAME_RGB, GAP_GRAY, WORK_WIDTH
from ..functions import vision
from ..operators.frames import observe, packed
from ..registry import query, table
from ..shipping import ship

#: The grid: images of 64 x 48 pixels.
IMAGES, WIDTH, HEIGHT = 20, 64, 48

_GRID = f"""v_grid AS (SELECT CAST(i // {WIDTH * HEIGHT} AS BIGINT) AS img, CAST(i // {WIDTH} % {HEIGHT} AS BIGINT) AS y, CAST(i % {WIDTH} AS BIGINT) AS x FROM (SELECT unnest(range({IMAGES * WIDTH * HEIGHT})) AS i)),
v_rgb AS (SELECT img, y, x, CASE WHEN edge THEN 255 ELSE (x * 7 + y * 3 + img * 11) % 256 END AS r, CASE WHEN edge THEN 0 ELSE (x * 5 + y * 13 + img) % 256 END AS g, CASE WHEN edge THEN 170 ELSE (x * 3 + y * 7 + img * 5) % 256 END AS b
    FROM (SELECT *, x BETWEEN 10 + img % 5 AND 50 AND y BETWEEN 8 AND 40 - img % 7 AND (x < 14 + img % 5 OR x > 46 OR y < 12 OR y > 36 - img % 7) AS edge FROM v_grid))"""
_HUE = """v_hue AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS chroma,
    CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0 WHEN greatest(r, g, b) = r THEN 60 * ((((g - b) / (greatest(r, g, b) - least(r, g, b))) % 6 + 6) % 6)
         WHEN greatest(r, g, b) = g THEN 60 * ((b - r) / (greatest(r, g, b) - least(r, g, b)) + 2) ELSE 60 * ((r - g) / (greatest(r, g, b) - least(r, g, b)) + 4) END AS hue FROM v_rgb),
v_mask AS (SELECT img, y, x FROM v_hue WHERE chroma >= 40 AND chroma >= 0.35 * hi AND hue >= 280 AND hue <= 352)"""


def grid(spark: SparkSession) -> DataFrame:
    """img, y, x, r, g, b: a magenta frame on a wavy ground."""
    i = F.col("id")
    at = spark.range(IMAGES * WIDTH * HEIGHT).select(F.floor(i / (WIDTH * HEIGHT)).alias("img"), F.pmod(F.floor(i / WIDTH), F.lit(HEIGHT)).alias("y"), (i % WIDTH).alias("x"))
    x, y, m = F.col("x"), F.col("y"), F.col("img")
    inside = x.between(10 + m % 5, F.lit(50)) & y.between(F.lit(8), 40 - m % 7)
    edge = inside & ((x < 14 + m % 5) | (x > 46) | (y < 12) | (y > 36 - m % 7))
    pick = lambda solid, ground: F.when(edge, solid).otherwise(ground % 256)
    return at.select("img", "y", "x", pick(255, x * 7 + y * 3 + m * 11).alias("r"), pick(0, x * 5 + y * 13 + m).alias("g"), pick(170, x * 3 + y * 7 + m * 5).alias("b"))


def magenta(r: Column, g: Column, b: Column) -> Column:
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    chroma = hi - lo
    turn = (g - b) / chroma
    hue = F.when(chroma == 0, 0.0).when(hi == r, 60 * F.pmod(turn, F.lit(6.0))).when(hi == g, 60 * ((b - r) / chroma + 2)).otherwise(60 * ((r - g) / chroma + 4))
    return (chroma >= 40) & (chroma >= 0.35 * hi) & (hue >= 280) & (hue <= 352)


def mask(spark: SparkSession) -> DataFrame:
    # A lambda's variable is bound once; written out, the colour would be repeated in every branch of the hue.
    pixel = F.array(F.struct("r", "g", "b"))
    return grid(spark).where(F.exists(pixel, lambda p: magenta(p["r"], p["g"], p["b"]))).select("img", "y", "x")


@query(f"WITH {_GRID}, {_HUE} SELECT * FROM v_mask")
def magenta_mask(spark: SparkSession, d: str) -> DataFrame:
    return mask(spark)


@query(f"WITH {_GRID}, {_HUE} SELECT DISTINCT img, y + dy AS y, x + dx AS x FROM v_mask, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) WHERE y + dy BETWEEN 0 AND {HEIGHT - 1} AND x + dx BETWEEN 0 AND {WIDTH - 1}")
def dilate3x3(spark: SparkSession, d: str) -> DataFrame:
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    moved = mask(spark).select("img", "y", "x", near.alias("d")).select("img", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    return moved.where(F.col("y").between(0, HEIGHT - 1) & F.col("x").between(0, WIDTH - 1)).distinct()


@query(f"WITH {_GRID}, {_HUE} SELECT img, y, min(x) AS x0, max(x) AS x1, count(*) AS n FROM v_mask GROUP BY ALL")
def row_extremes(spark: SparkSession, d: str) -> DataFrame:
    return mask(spark).groupBy("img", "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"))


#: Specks on the same grid, and the least pixel number that each reaches over its eight neighbours.
_SPECKS = f"""v_speck AS (SELECT img, y, x, y * {WIDTH} + x AS spot FROM (SELECT CAST(i // {WIDTH * HEIGHT} AS BIGINT) AS img, CAST(i // {WIDTH} % {HEIGHT} AS BIGINT) AS y, CAST(i % {WIDTH} AS BIGINT) AS x FROM (SELECT unnest(range({IMAGES * WIDTH * HEIGHT})) AS i))
    WHERE (x * x * 7 + y * y * 13 + x * y * 5 + img * 17) % 101 < 25),
v_reach AS (SELECT img, spot AS start, spot, y, x FROM v_speck UNION SELECT r.img, r.start, s.spot, s.y, s.x FROM v_reach r JOIN v_speck s ON s.img = r.img AND abs(s.y - r.y) <= 1 AND abs(s.x - r.x) <= 1),
v_label AS (SELECT img, spot // {WIDTH} AS y, spot % {WIDTH} AS x, min(start) AS label FROM v_reach GROUP BY img, spot)"""
_BOX = "SELECT img, label, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)) AS fill FROM v_label GROUP BY img, label"


def specks(spark: SparkSession) -> DataFrame:
    x, y, m = F.col("x"), F.col("y"), F.col("img")
    return grid(spark).select("img", "y", "x").where((x * x * 7 + y * y * 13 + x * y * 5 + m * 17) % 101 < 25)


def labelled(pixels: DataFrame) -> DataFrame:
    """img, y, x, label: the pixels of a mask with their 8-connected component, named by its least pixel number. An image's pixels are gathered, which its size bounds."""
    ship(pixels.sparkSession)
    masks = pixels.groupBy("img").agg(F.collect_list(F.col("y") * WIDTH + F.col("x")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for img, at in zip(batch.column("img"), batch.column("at"), strict=True):
                where = np.sort(at.values.to_numpy())
                mask = np.zeros(WIDTH * HEIGHT, bool)
                mask[where] = True
                label = vision.components(mask.reshape(HEIGHT, WIDTH)).ravel()[where]
                yield pa.RecordBatch.from_arrays([pa.repeat(img, len(where)), pa.array(where // WIDTH), pa.array(where % WIDTH), pa.array(label.astype(np.int64))], names=["img", "y", "x", "label"])

    return masks.mapInArrow(run, "img bigint, y bigint, x bigint, label bigint")


@query(f"WITH RECURSIVE {_SPECKS} SELECT * FROM v_label")
def component_labels(spark: SparkSession, d: str) -> DataFrame:
    return labelled(specks(spark))


def boxes(labels: DataFrame) -> DataFrame:
    w, h = F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1
    return labels.groupBy("img", "label").agg(F.count("*").alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), w.alias("w"), h.alias("h"), (F.count("*") / (w * h)).alias("fill"))


@query(f"WITH RECURSIVE {_SPECKS} {_BOX}")
def component_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Area, bounding box and fill of every component."""
    return boxes(labelled(specks(spark)))


@query(f"WITH RECURSIVE {_SPECKS} SELECT img, label, area, rank FROM (SELECT img, label, area, row_number() OVER (PARTITION BY img ORDER BY area DESC, label) AS rank FROM ({_BOX})) WHERE rank <= 3")
def largest_components(spark: SparkSession, d: str) -> DataFrame:
    """The three largest components of each image."""
    rank = F.row_number().over(Window.partitionBy("img").orderBy(F.col("area").desc(), "label")).cast("bigint")
    return boxes(labelled(specks(spark))).select("img", "label", "area", rank.alias("rank")).where("rank <= 3")


@query(f"WITH {_GRID} SELECT img, y // 2 AS y, x // 2 AS x, CAST((sum(r) + 2) >> 2 AS BIGINT) AS r, CAST((sum(g) + 2) >> 2 AS BIGINT) AS g, CAST((sum(b) + 2) >> 2 AS BIGINT) AS b FROM v_rgb GROUP BY img, y // 2, x // 2".replace("sum(r)", "CAST(sum(r) AS BIGINT)").replace("sum(g)", "CAST(sum(g) AS BIGINT)").replace("sum(b)", "CAST(sum(b) AS BIGINT)"))
def halve_2x2(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c: F.shiftright(F.sum(c) + 2, 2).alias(c)
    return grid(spark).groupBy("img", F.floor(F.col("y") / 2).alias("y2"), F.floor(F.col("x") / 2).alias("x2")).agg(mean("r"), mean("g"), mean("b")).withColumnsRenamed({"y2": "y", "x2": "x"})


@query(f"WITH {_GRID} SELECT img, y // 6 AS gy, x // 8 AS gx, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM v_rgb GROUP BY img, y // 6, x // 8")
def area_resample(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return grid(spark).groupBy("img", F.floor(F.col("y") / 6).alias("gy"), F.floor(F.col("x") / 8).alias("gx")).agg(mean("r"), mean("g"), mean("b"))


@query(f"WITH {_GRID} SELECT img, y, x, r FROM v_rgb WHERE y % 4 = 2 AND x % 4 = 2")
def nearest_downsample(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark).where("y % 4 = 2 AND x % 4 = 2").select("img", "y", "x", "r")


@query(f"""WITH {_GRID}, v_luma AS (SELECT img, y // 3 AS gy, x // 4 AS gx, avg(0.299 * r + 0.587 * g + 0.114 * b) AS v FROM v_rgb GROUP BY ALL),
v_centred AS (SELECT img, v, gy - 7.5 AS cy, gx - 7.5 AS cx FROM v_luma),
v_plane AS (SELECT img, avg(v) AS m, sum(v * cx) / sum(cx * cx) AS sx, sum(v * cy) / sum(cy * cy) AS sy FROM v_centred GROUP BY img)
SELECT img, round(sqrt(avg((v - m - sx * cx - sy * cy) ** 2)), 6) AS residual, sqrt(avg((v - m - sx * cx - sy * cy) ** 2)) < 2 AS is_gap FROM v_centred JOIN v_plane USING (img) GROUP BY img""")
def gap_residual(spark: SparkSession, d: str) -> DataFrame:
    """Texture left after a plane is taken off 16 x 16 means of brightness."""
    luma = grid(spark).groupBy("img", F.floor(F.col("y") / 3).alias("gy"), F.floor(F.col("x") / 4).alias("gx")).agg(F.avg(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).alias("v"))
    c = luma.select("img", "v", (F.col("gy") - 7.5).alias("cy"), (F.col("gx") - 7.5).alias("cx"))
    plane = c.groupBy("img").agg(F.avg("v").alias("m"), (F.sum(F.col("v") * F.col("cx")) / F.sum(F.col("cx") * F.col("cx"))).alias("sx"), (F.sum(F.col("v") * F.col("cy")) / F.sum(F.col("cy") * F.col("cy"))).alias("sy"))
    rest = F.col("v") - F.col("m") - F.col("sx") * F.col("cx") - F.col("sy") * F.col("cy")
    rms = F.sqrt(F.avg(rest * rest))
    return c.join(plane, "img").groupBy("img").agg(F.round(rms, 6).alias("residual"), (rms < 2).alias("is_gap"))


@query(f"WITH {_GRID}, {_HUE} SELECT img, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)), 5) AS angle FROM v_mask WHERE y < 12 GROUP BY img")
def pca_line(spark: SparkSession, d: str) -> DataFrame:
    """Centre and direction of the points along the upper side."""
    angle = 0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))
    return mask(spark).where("y < 12").groupBy("img").agg(F.round(F.avg("x"), 6).alias("mx"), F.round(F.avg("y"), 6).alias("my"), F.round(angle, 5).alias("angle"))


_QUAD = "v_corner AS (SELECT img, k, CASE k WHEN 0 THEN 10.0 + img % 5 WHEN 1 THEN 50.0 WHEN 2 THEN 50.0 + img % 3 ELSE 10.0 END AS px, CASE k WHEN 0 THEN 8.0 WHEN 1 THEN 8.0 + img % 2 WHEN 2 THEN 40.0 - img % 7 ELSE 40.0 END AS py FROM (SELECT unnest(range(20)) AS img), (SELECT unnest(range(4)) AS k))"


def corners(spark: SparkSession) -> DataFrame:
    k, m = F.col("k"), F.col("img")
    rows = spark.range(IMAGES).select(F.col("id").alias("img"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    px = F.when(k == 0, 10.0 + m % 5).when(k == 1, 50.0).when(k == 2, 50.0 + m % 3).otherwise(10.0)
    py = F.when(k == 0, 8.0).when(k == 1, 8.0 + m % 2).when(k == 2, 40.0 - m % 7).otherwise(40.0)
    return rows.select("img", k.cast("bigint").alias("k"), px.alias("px"), py.alias("py"))


@query(f"WITH {_QUAD} SELECT a.img, abs(sum(a.px * b.py - b.px * a.py)) / 2 AS area FROM v_corner a JOIN v_corner b ON a.img = b.img AND b.k = (a.k + 1) % 4 GROUP BY a.img")
def shoelace(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("img").orderBy("k")
    nxt = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(order))
    rows = corners(spark).withColumn("qx", nxt("px")).withColumn("qy", nxt("py"))
    return rows.groupBy("img").agg((F.abs(F.sum(F.col("px") * F.col("qy") - F.col("qx") * F.col("py"))) / 2).alias("area"))


@query(f"WITH {_QUAD} SELECT img, k, row_number() OVER (PARTITION BY img ORDER BY (k - first_k + 4) % 4) - 1 AS corner FROM (SELECT img, k, arg_min(k, px + py) OVER (PARTITION BY img) AS first_k FROM v_corner)")
def corner_order(spark: SparkSession, d: str) -> DataFrame:
    """Corners by angle about the centre, from the one nearest the origin."""
    img = Window.partitionBy("img")
    c = F.col
    angle = F.atan2(c("py") - F.avg("py").over(img), c("px") - F.avg("px").over(img))
    ranked = corners(spark).withColumn("angle", angle)
    ranked = ranked.withColumn("r", F.row_number().over(img.orderBy("angle")) - 1).withColumn("near", F.row_number().over(img.orderBy(c("px") + c("py"), "k")))
    first = F.max(F.when(c("near") == 1, c("r"))).over(img)
    return ranked.select("img", "k", F.pmod(c("r") - first, F.lit(4)).cast("bigint").alias("corner"))


@query(f"WITH {_QUAD} SELECT a.img, a.k AS k1, b.k AS k2, round(sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2), 6) AS dist FROM v_corner a JOIN v_corner b ON a.img = b.img AND a.k < b.k QUALIFY row_number() OVER (PARTITION BY a.img ORDER BY round(sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2), 6) DESC, a.k, b.k) = 1")
def farthest_pair(spark: SparkSession, d: str) -> DataFrame:
    a, b = corners(spark).alias("a"), corners(spark).alias("b")
    dist = F.round(F.sqrt(F.pow(F.col("a.px") - F.col("b.px"), 2) + F.pow(F.col("a.py") - F.col("b.py"), 2)), 6)
    pairs = a.join(b, (F.col("a.img") == F.col("b.img")) & (F.col("a.k") < F.col("b.k"))).select("a.img", F.col("a.k").alias("k1"), F.col("b.k").alias("k2"), dist.alias("dist"))
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("img").orderBy(F.col("dist").desc(), "k1", "k2"))).where("r = 1").drop("r")


_H = (1.1, 0.05, 3.0, -0.02, 0.95, 2.0, 0.0004, -0.0003, 1.0)


@query(f"WITH {_QUAD} SELECT img, k, round(({_H[0]} * px + {_H[1]} * py + {_H[2]}) / ({_H[6]} * px + {_H[7]} * py + 1), 6) AS u, round(({_H[3]} * px + {_H[4]} * py + {_H[5]}) / ({_H[6]} * px + {_H[7]} * py + 1), 6) AS v FROM (SELECT img, k, px::DOUBLE AS px, py::DOUBLE AS py FROM v_corner)")
def homography_apply(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("px"), F.col("py")
    w = _H[6] * x + _H[7] * y + 1
    return corners(spark).select("img", "k", F.round((_H[0] * x + _H[1] * y + _H[2]) / w, 6).alias("u"), F.round((_H[3] * x + _H[4] * y + _H[5]) / w, 6).alias("v"))


@query(f"WITH {_QUAD} SELECT img, k, px AS u, py AS v FROM v_corner")
def homography_solve(spark: SparkSession, d: str) -> DataFrame:
    """Maps of the unit square to four corners, solved and put to use: they reach the corners, and their inverses come back."""
    ship(spark)
    four = corners(spark).groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "px", "py"))), lambda c: F.array(c["px"], c["py"])).alias("quad"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
        for batch in batches:
            for img, quad in zip(batch.column("img"), batch.column("quad").to_pylist(), strict=True):
                h = vision.homography(unit, np.array(quad))
                there = vision.mapped(h, unit)
                back = vision.mapped(vision.inverse(h), there)
                at = np.round(np.where(np.abs(back - unit) < 1e-6, there, np.nan), 6)
                yield pa.RecordBatch.from_arrays([pa.repeat(img, 4), pa.array(np.arange(4)), pa.array(at[:, 0]), pa.array(at[:, 1])], names=["img", "k", "u", "v"])

    return four.mapInArrow(run, "img bigint, k bigint, u double, v double")


def frame_square(w: Column, h: Column) -> dict[str, Column]:
    """Place and sizes, in whole pixels, of the square that a sender draws on a canvas; halves are rounded up."""
    up = lambda c: F.floor(c + 0.5).cast("bigint")
    side = up(F.least(w, h) * F.lit(FRAME_OUTER))
    border = up(side * F.lit(FRAME_BORDER))
    return {"side": side, "border": border, "x": up((w - side) / 2), "y": up((h - side) / 2), "inner": side - 2 * border}


_SQUARE = f"""(SELECT *, CAST(floor((w - side) / 2 + 0.5) AS BIGINT) AS x, CAST(floor((h - side) / 2 + 0.5) AS BIGINT) AS y, side - 2 * border AS "inner" FROM
    (SELECT *, CAST(floor(side * {FRAME_BORDER}::DOUBLE + 0.5) AS BIGINT) AS border FROM (SELECT *, CAST(floor(least(w, h) * {FRAME_OUTER}::DOUBLE + 0.5) AS BIGINT) AS side FROM {{canvas}})))"""


@query('SELECT event_id, side, border, x, y, "inner" FROM ' + _SQUARE.format(canvas="(SELECT event_id, 100 + event_id * 37 % 1821 AS w, 100 + event_id * 53 % 981 AS h FROM events)"))
def frame_geometry(spark: SparkSession, d: str) -> DataFrame:
    """The sender's square on canvases of many sizes, one for each event."""
    w, h = 100 + F.col("event_id") * 37 % 1821, 100 + F.col("event_id") * 53 % 981
    return table(spark, d, "events").select("event_id", *[c.alias(k) for k, c in frame_square(w, h).items()])


SCENES = 24


def scenes(spark: SparkSession) -> DataFrame:
    """img, y, x, r, g, b: canvases as a sender draws them. One quarter of the symbol is bright; of six canvases one shows the gap and one nothing."""
    w, h = 160 + F.col("img") % 3 * 16, 120 + F.col("img") % 2 * 20
    canvas = spark.range(SCENES).withColumnRenamed("id", "img").select("img", w.alias("w"), h.alias("h"), *[c.alias(f"_{k}") for k, c in frame_square(w, h).items()])
    rows = canvas.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    c = F.col
    u, v = c("x") - c("_x"), c("y") - c("_y")
    deep = F.least(u, v, c("_side") - 1 - u, c("_side") - 1 - v)
    quarter = (2 * (v - c("_border")) >= c("_inner")).cast("int") * 2 + (2 * (u - c("_border")) >= c("_inner")).cast("int")
    kind = F.when((deep < 0) | (c("img") % 6 == 5), "ground").when(deep < c("_border"), "frame").when(c("img") % 6 == 4, "gap").when(quarter == c("img") % 4, "bright").otherwise("dark")
    colours = {"ground": (0, 0, 0), "frame": FRAME_RGB, "gap": (GAP_GRAY,) * 3, "bright": (250, 240, 60), "dark": (20, 30, 90)}
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in colours.items() for x in (k, v[i])])[kind]
    return rows.select("img", "y", "x", pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))


@query(
    f"SELECT img, CASE WHEN img % 6 = 5 THEN 'none' ELSE 'ok' END AS status, img % 6 >= 4 AS gap, CAST(CASE WHEN img % 6 < 4 THEN img % 4 END AS INT) AS cls, img % 6 <> 5 AS found FROM (SELECT CAST(unnest(range({SCENES})) AS BIGINT) AS img)"
)
def frame_observations(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain on images: raster, locate the frame, crop, test for a gap, score, decide. The oracle is what was drawn.

    The scorer is a stand-in that rates the four classes by the brightness of the crop's quarters. found: whether the
    corner that was located is within three pixels of the one that was drawn, on the raster.
    """
    ship(spark)

    def load() -> Callable[[np.ndarray], np.ndarray]:
        def scorer(crops: np.ndarray) -> np.ndarray:
            n = crops.shape[1] // 2
            parts = [crops[:, a : a + n, b : b + n] for a in (0, n) for b in (0, n)]
            return np.stack([p.mean(axis=(1, 2, 3)) / 8 for p in parts], axis=1)

        return scorer

    img = F.col("img")
    w, h = 160 + img % 3 * 16, 120 + img % 2 * 20
    drawn = frame_square(w, h)
    off = F.greatest(F.abs(F.col("x") - drawn["x"] * WORK_WIDTH / w), F.abs(F.col("y") - drawn["y"] * WORK_WIDTH / w))
    return observe(packed(scenes(spark)), load, 16).select("img", "status", "gap", "cls", F.coalesce(off <= 3, F.lit(False)).alias("found"))


@query(
    f"""WITH {_GRID}, v_point AS (SELECT img, k, least(greatest(k * 9.25 - 1.5, 0), {WIDTH - 1})::DOUBLE AS cx, least(greatest(k * 7.5 - 0.25, 0), {HEIGHT - 1})::DOUBLE AS cy FROM (SELECT CAST(unnest(range({IMAGES})) AS BIGINT) AS img), (SELECT CAST(unnest(range(8)) AS BIGINT) AS k)),
v_near AS (SELECT *, floor(cx) AS x0, least(floor(cx) + 1, {WIDTH - 1}) AS x1, cx - floor(cx) AS fx, floor(cy) AS y0, least(floor(cy) + 1, {HEIGHT - 1}) AS y1, cy - floor(cy) AS fy FROM v_point)
SELECT p.img, p.k, round((1 - fy) * ((1 - fx) * a.r + fx * b.r) + fy * ((1 - fx) * c.r + fx * d.r), 6) AS r FROM v_near p
JOIN v_rgb a ON a.img = p.img AND a.x = x0 AND a.y = y0 JOIN v_rgb b ON b.img = p.img AND b.x = x1 AND b.y = y0 JOIN v_rgb c ON c.img = p.img AND c.x = x0 AND c.y = y1 JOIN v_rgb d ON d.img = p.img AND d.x = x1 AND d.y = y1"""
)
def bilinear_sample(spark: SparkSession, d: str) -> DataFrame:
    """Values between pixels, and beyond the edge, where they are those of the edge."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = np.arange(8)
        at = np.stack([k * 9.25 - 1, k * 7.5 + 0.25], axis=1)
        for batch in batches:
            for img, rgb in zip(batch.column("img"), batch.column("rgb").to_pylist(), strict=True):
                value = vision.sampled(np.frombuffer(rgb, np.uint8).reshape(HEIGHT, WIDTH, 3).astype(np.float64), at)
                yield pa.RecordBatch.from_arrays([pa.repeat(img, 8), pa.array(k), pa.array(np.round(value[:, 0], 6))], names=["img", "k", "r"])

    return packed(grid(spark)).select("img", "rgb").mapInArrow(run, "img bigint, k bigint, r double")


@query(
    "WITH square AS (SELECT * FROM " + _SQUARE.format(canvas=f"(SELECT img, 160 + img % 3 * 16 AS w, 120 + img % 2 * 20 AS h FROM (SELECT CAST(unnest(range({SCENES})) AS BIGINT) AS img) WHERE img % 6 <> 5)") + ") "
    "SELECT img, k, (x + CASE WHEN k IN (1, 2) THEN side ELSE 0 END)::DOUBLE AS px, (y + CASE WHEN k >= 2 THEN side ELSE 0 END)::DOUBLE AS py FROM square, (SELECT CAST(unnest(range(4)) AS BIGINT) AS k)"
)
def frame_quads(spark: SparkSession, d: str) -> DataFrame:
    """Corners of the sender's square by mask, components, outline and largest quadrilateral, clockwise from the one nearest the origin."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for img, w, h, rgb in zip(*(batch.column(c).to_pylist() for c in ("img", "width", "height", "rgb")), strict=True):
                mask = vision.magenta(np.frombuffer(rgb, np.uint8).reshape(h, w, 3))
                label = vision.components(mask)
                for kind, _ in vision.largest(label, 1, 1):
                    quad = vision.largest_quad(vision.outline(vision.rim_points(label == kind)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(4, img)), pa.array(np.arange(4)), pa.array(quad[:, 0]), pa.array(quad[:, 1])], names=["img", "k", "px", "py"])

    return packed(scenes(spark)).mapInArrow(run, "img bigint, k bigint, px double, py double")
