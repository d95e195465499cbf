"""Readers: class manifests, model metadata, labelled folders, candidates, stored history, packed fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import END, START

IMAGE_TYPES = ("jpg", "jpeg", "png", "webp")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """cls, file: a JSON array of files, whose place is the class, and the control files."""
    whole = spark.read.text(path, wholetext=True)
    listed = whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("cls", "file"))
    return listed.unionByName(spark.createDataFrame([(START, "start.png"), (END, "end.png")], "cls int, file string"))


def model_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def labelled_folder(spark: SparkSession, path: str, repeat: int = 1) -> DataFrame:
    """cls, path, content, turns: images in folders named by class, each ``repeat`` times with its own quarter turns."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jpg").load(path)
    cls = F.regexp_extract("path", r"/([0-9]+)/[^/]+$", 1)
    rows = files.select(cls.alias("c"), "path", "content").where("c <> ''")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(repeat))))
    return copies.select(F.col("c").cast("int").alias("cls"), "path", "content", F.pmod(F.xxhash64("path", "copy"), F.lit(4)).cast("int").alias("turns"))


def target_of(stem):
    """Class named by a file's stem, null for others."""
    name = F.upper(stem)
    number = F.when(F.regexp_like(stem, F.lit("^[0-9]{1,3}$")), stem.try_cast("int"))
    return F.when(name == "START", START).when(name == "END", END).when(number < 256, number)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """target, path, content of images whose name says which class they would replace; other files are skipped."""
    files = spark.read.format("binaryFile").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.where(kind.isin(*IMAGE_TYPES) & (F.length("content") > 0)).select(target_of(stem).cast("int").alias("target"), "path", "content").where("target IS NOT NULL")


def stored_history(spark: SparkSession, path: str) -> DataFrame:
    """id, text, at of a stored JSON array; nothing if it is broken, and no items without text."""
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<struct<id:string,text:string,at:bigint>>", {"mode": "PERMISSIVE"})
    return whole.select(F.inline(items)).where("text IS NOT NULL")


def packed_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, gzipped or not, with a base64 column rgb."""
    return spark.read.json(path).withColumn("rgb", F.unbase64("rgb"))


def every_nth(rows: DataFrame, order: str, video_fps: float, fps: float, key: str) -> DataFrame:
    """Rows at every max(1, round(video_fps / fps))-th place of their stream, which ``key`` names: one task sorts one stream."""
    step = max(1, round(video_fps / fps))
    window = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_place", F.row_number().over(window) - 1).where(F.col("_place") % step == 0).drop("_place")


def ranking(spark: SparkSession, path: str) -> DataFrame:
    """Classes with their figures as ``sinks.write_ranking`` left them."""
    return spark.read.json(path)


def class_images(spark: SparkSession, manifest: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """cls, file, content of the classes that are asked for, each once; only their files are read."""
    wanted = manifest.join(classes.select("cls").distinct(), "cls", "left_semi").select("cls", "file")
    names = [r.file for r in wanted.select("file").distinct().collect()]  # of a manifest of a few hundred classes
    if not names:
        return wanted.withColumn("content", F.lit(None).cast("binary"))
    files = spark.read.format("binaryFile").load([f"{folder.rstrip('/')}/{n}" for n in names])
    return wanted.join(files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content"), "file").select("cls", "file", "content")
