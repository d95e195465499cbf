"""Class dimensions, history of messages, target names: lookups, semi and anti joins, upserts, islands of equal text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import HISTORY_CAP
from ..registry import query, table
from ..sources.views import observations, sql

_MANIFEST = "manifest AS (SELECT CAST(p_partkey % 256 AS INT) AS cls, min('r' || lpad((p_partkey % 256)::VARCHAR, 3, '0') || '-' || sha1(p_name)[:6] || '.jpg') AS file FROM part GROUP BY ALL UNION ALL SELECT 256, 'start.png' UNION ALL SELECT 257, 'end.png')"


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """cls, file: content-named files of 256 classes, and those of the two control classes."""
    cls = (F.col("p_partkey") % 256).cast("int")
    name = F.concat(F.lit("r"), F.lpad(cls.cast("string"), 3, "0"), F.lit("-"), F.substring(F.sha1(F.encode("p_name", "UTF-8")), 1, 6), F.lit(".jpg"))
    control = spark.createDataFrame([(256, "start.png"), (257, "end.png")], "cls int, file string")
    return table(spark, d, "part").select(cls.alias("cls"), name.alias("file")).groupBy("cls").agg(F.min("file").alias("file")).unionByName(control)


@query(f"WITH {_MANIFEST} SELECT * FROM manifest")
def manifest_dim(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d)


@query(sql("SELECT 1", "v_obs").removesuffix(" SELECT 1") + f", {_MANIFEST} SELECT o.seq, o.cls, m.file FROM v_obs o JOIN manifest m USING (cls)")
def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Observations with their class's file; the dimension has at most 258 rows and is broadcast."""
    return observations(spark, d).select("seq", "cls").join(F.broadcast(manifest(spark, d)), "cls").select("seq", "cls", "file")


@query(sql("SELECT 1", "v_obs").removesuffix(" SELECT 1") + f", {_MANIFEST} SELECT * FROM manifest WHERE cls IN (SELECT cls FROM v_obs WHERE NOT gap)")
def used_classes_semi(spark: SparkSession, d: str) -> DataFrame:
    seen = observations(spark, d).where(~F.col("gap") & F.col("cls").isNotNull()).select("cls").distinct()
    return manifest(spark, d).join(seen, "cls", "left_semi")


@query(sql("SELECT 1", "v_obs").removesuffix(" SELECT 1") + f", {_MANIFEST} SELECT * FROM manifest WHERE cls NOT IN (SELECT cls FROM v_obs WHERE cls IS NOT NULL)")
def unreferenced_anti(spark: SparkSession, d: str) -> DataFrame:
    """Files of classes that no observation names."""
    return manifest(spark, d).join(observations(spark, d).select("cls").distinct(), "cls", "left_anti")


_NEW = "(SELECT CAST(s_suppkey % 256 AS INT) AS cls, 'r' || lpad((s_suppkey % 256)::VARCHAR, 3, '0') || '-' || sha1(max(s_name))[:6] || '.jpg' AS file FROM supplier GROUP BY s_suppkey % 256)"


def replacements(spark: SparkSession, d: str) -> DataFrame:
    cls = (F.col("s_suppkey") % 256).cast("int")
    one = table(spark, d, "supplier").groupBy(cls.alias("cls")).agg(F.max("s_name").alias("name"))
    return one.select("cls", F.concat(F.lit("r"), F.lpad(F.col("cls").cast("string"), 3, "0"), F.lit("-"), F.substring(F.sha1(F.encode("name", "UTF-8")), 1, 6), F.lit(".jpg")).alias("file"))


@query(f"WITH {_MANIFEST} SELECT m.cls, coalesce(n.file, m.file) AS file, n.file IS NOT NULL AND n.file <> m.file AS replaced FROM manifest m LEFT JOIN {_NEW} n USING (cls)")
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = replacements(spark, d).withColumnRenamed("file", "new_file")
    return manifest(spark, d).join(F.broadcast(new), "cls", "left").select("cls", F.coalesce("new_file", "file").alias("file"), F.coalesce(F.col("new_file") != F.col("file"), F.lit(False)).alias("replaced"))


@query(f"WITH {_MANIFEST} SELECT DISTINCT m.file FROM manifest m JOIN {_NEW} n USING (cls) WHERE n.file <> m.file AND m.file NOT IN (SELECT file FROM {_NEW})")
def replaced_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that nothing names any more after the upsert."""
    old, new = manifest(spark, d), replacements(spark, d)
    gone = old.join(F.broadcast(new.withColumnRenamed("file", "new_file")), "cls").where("file <> new_file").select("file").distinct()
    return gone.join(F.broadcast(new), "file", "left_anti")


_HISTORY = "SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, any_value(text) AS text, count(*) AS n FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn) <> text, true) AS fresh FROM conversations)) GROUP BY conv_id, run"


def history(rows: DataFrame, stream: str, at: str, text: str) -> DataFrame:
    """Messages of each stream with runs of the same text as one, at their last time."""
    order = Window.partitionBy(stream).orderBy(at)
    fresh = F.coalesce(F.lag(text).over(order) != F.col(text), F.lit(True))
    runs = rows.withColumn("fresh", fresh).withColumn("run", F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(stream, "run").agg(F.min(at).alias("first_turn"), F.max(at).alias("last_turn"), F.first(text).alias("text"), F.count("*").alias("n")).drop("run")


@query(_HISTORY)
def history_dedup(spark: SparkSession, d: str) -> DataFrame:
    return history(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query(f"SELECT conv_id, last_turn, text, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id DESC, last_turn DESC) AS rank FROM ({_HISTORY})) WHERE rank <= {HISTORY_CAP}")
def history_top50(spark: SparkSession, d: str) -> DataFrame:
    """The newest messages of each of five devices."""
    rank = F.row_number().over(Window.partitionBy(F.col("conv_id") % 5).orderBy(F.col("conv_id").desc(), F.col("last_turn").desc()))
    kept = history(table(spark, d, "conversations"), "conv_id", "turn", "text").withColumn("rank", rank.cast("bigint"))
    return kept.where(F.col("rank") <= HISTORY_CAP).select("conv_id", "last_turn", "text", "rank")


@query("SELECT conv_id, turn FROM conversations WHERE NOT (conv_id % 7 = 3 AND turn = 0)")
def history_remove(spark: SparkSession, d: str) -> DataFrame:
    """History without the items that were removed by id."""
    return table(spark, d, "conversations").where(~((F.col("conv_id") % 7 == 3) & (F.col("turn") == 0))).select("conv_id", "turn")


@query("SELECT conv_id, turn, text FROM conversations WHERE (conv_id + turn) % 3 = 0 AND text IS NOT NULL")
def history_json_guard(spark: SparkSession, d: str) -> DataFrame:
    """Items read back from stored JSON, of which a third is sound, a third lacks its text and a third is broken."""
    kind = (F.col("conv_id") + F.col("turn")) % 3
    whole = F.to_json(F.struct("conv_id", "turn", "text"))
    stored = F.when(kind == 0, whole).when(kind == 1, F.to_json(F.struct("conv_id", "turn"))).otherwise(F.concat(F.lit("{broken"), whole))
    read = F.from_json(stored, "conv_id bigint, turn bigint, text string", {"mode": "PERMISSIVE"})
    return table(spark, d, "conversations").select(read.alias("x")).select("x.*").where("text IS NOT NULL")


@query("SELECT conv_id, turn, strftime(make_timestamp(1700000000000000 + conv_id * 3600000000 + turn * 60000000), '%d/%m %H:%M') AS shown FROM conversations")
def history_dates(spark: SparkSession, d: str) -> DataFrame:
    """Epoch milliseconds as a short date in UTC."""
    ms = F.lit(1_700_000_000_000) + F.col("conv_id") * 3_600_000 + F.col("turn") * 60_000
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ms / 1000)
    return table(spark, d, "conversations").select("conv_id", "turn", F.date_format(at, "dd/MM HH:mm").alias("shown"))


@query(
    "SELECT p_partkey, stem, CASE WHEN upper(stem) IN ('START', 'END') THEN CASE upper(stem) WHEN 'START' THEN 256 ELSE 257 END WHEN regexp_full_match(stem, '[0-9]{1,3}') AND CAST(stem AS INT) < 256 THEN CAST(stem AS INT) END AS target "
    "FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'start' WHEN p_partkey % 11 = 1 THEN 'End' WHEN p_partkey % 11 = 2 THEN 'x' || p_partkey ELSE p_partkey::VARCHAR END AS stem FROM part)"
)
def target_parse(spark: SparkSession, d: str) -> DataFrame:
    """Class named by a file's stem: START, END or a number under 256."""
    key = F.col("p_partkey")
    kind = key % 11
    stem = F.when(kind == 0, "start").when(kind == 1, "End").when(kind == 2, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string"))
    rows = table(spark, d, "part").select("p_partkey", stem.alias("stem"))
    number = F.when(F.regexp_like("stem", F.lit("^[0-9]{1,3}$")), F.col("stem").try_cast("int"))
    name = F.upper("stem")
    return rows.select("p_partkey", "stem", F.when(name == "START", 256).when(name == "END", 257).when(number < 256, number).alias("target"))


@query("SELECT doc_id, 'm' || lpad(doc_id::VARCHAR, 6, '0') || '-' || sha1(text)[:5] AS id FROM documents")
def message_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids made of a time and a hash, so that a run gives the same ones again."""
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("-"), F.substring(F.sha1(F.encode("text", "UTF-8")), 1, 5)).alias("id"))
