"""Sample pools: seeded class mixes, pools kept on disk, mixtures, rejection by label."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import END, NONE, START


def uniform(seed: int, salt: int, key: str = "id") -> Column:
    """0 to 1 by a hash of the row's number, the same in every run and however rows are dealt."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(salt)), F.lit(1 << 53)) / float(1 << 53)


def labels(spark: SparkSession, n: int, seed: int, p_none: float = 0.12, focus: tuple[int, ...] = (), p_focus: float = 0.3) -> DataFrame:
    """id, label: nothing, START (5 %), END (3 %) or a uniform byte; classes in focus are drawn first."""
    u = uniform(seed, 1)
    mixed = F.when(u < p_none, NONE).when(u < p_none + 0.05, START).when(u < p_none + 0.08, END).otherwise(F.floor(uniform(seed, 2) * 256))
    rows = spark.range(n)
    if focus:
        pick = F.get(F.array(*map(F.lit, focus)), F.floor(uniform(seed, 4) * len(focus)).cast("int"))
        mixed = F.when(uniform(seed, 3) < p_focus, pick).otherwise(mixed)
    return rows.select("id", mixed.cast("int").alias("label"))


def kept_pool(spark: SparkSession, folder: str, params: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """A pool made once for each set of parameters and read after that."""
    name = hashlib.sha1(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/pool-{name}"
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def mixture(synthetic: DataFrame, stored: DataFrame, p_stored: float, seed: int) -> DataFrame:
    """(id, label, ...) where a share of the rows is taken from the stored ones, in turn."""
    held = stored.select(*[F.col(c) for c in synthetic.columns if c != "id"]).withColumns({"_part": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    sizes = sorted((r[0], r[1]) for r in held.groupBy("_part").count().collect())  # one number for each partition
    count = sum(n for _, n in sizes)
    if not count or p_stored <= 0:
        return synthetic
    base = F.create_map(*[F.lit(x) for k, (part, _) in enumerate(sizes) for x in (part, sum(n for _, n in sizes[:k]))])
    numbered = held.withColumn("_k", base[F.col("_part")] + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_part", "_m")
    taken = synthetic.select("id", (uniform(seed, 9) < p_stored).alias("_stored"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).alias("_k"))
    real = taken.where("_stored").join(numbered, "_k").select(*synthetic.columns)
    rest = synthetic.join(taken.where("NOT _stored").select("id"), "id", "left_semi")
    return rest.unionByName(real)


def of_class(rows: DataFrame, wanted: int, n: int, label: str = "label", order: str = "id") -> DataFrame:
    """The first n rows of the class among the first 4 n: tries, not a promise."""
    return rows.orderBy(order).limit(4 * n).where(F.col(label) == wanted).orderBy(order).limit(n)
