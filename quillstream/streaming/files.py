"""Tables read as unbounded streams, and where their state goes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """New files of a table's place, as they come."""
    batch = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    found = batch.inputFiles()
    inside = len(found) != 1 or not found[0].rstrip("/").endswith(f"{name}.parquet")
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if inside else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="quillstream-")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
