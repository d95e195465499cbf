"""Writers: logs, reports, history, exports by class, metrics, fixtures."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..constants import NONE

WRITERS = 16


def write_log(frames: DataFrame, slots: DataFrame, path: str, **about: str) -> None:
    """Frames and slots as JSON lines under one folder, beside a line that says what they are."""
    spark = frames.sparkSession
    frames.write.mode("overwrite").json(f"{path}/frames")
    slots.write.mode("overwrite").json(f"{path}/slots")
    spark.createDataFrame([about or {"version": "1"}], ", ".join(f"{k} string" for k in (about or {"version": "1"}))).coalesce(1).write.mode("overwrite").json(f"{path}/about")


def write_history(items: DataFrame, path: str) -> bool:
    """Whether the history could be stored."""
    try:
        items.write.mode("overwrite").json(path)
    except (AnalysisException, OSError) as e:
        logging.getLogger(__name__).warning("history not stored: %s", e)
        return False
    except Exception as e:  # py4j wraps what the file system raises
        logging.getLogger(__name__).warning("history not stored: %s", e)
        return False
    return True


def export_by_class(rows: DataFrame, path: str, label: str = "label") -> None:
    """Labelled rows in folders by class; gaps go to the class of nothing and rows without a label stay out.

    A class is dealt to WRITERS tasks, so that a common one is not written by one task alone.
    """
    cls = F.when(F.col(label) == "gap", NONE).otherwise(F.col(label).try_cast("int"))
    held = rows.where(F.col(label).isNotNull()).withColumn("cls", cls).where("cls IS NOT NULL")
    held.repartition(F.col("cls"), F.pmod(F.xxhash64(*rows.columns), F.lit(WRITERS))).write.mode("overwrite").partitionBy("cls").parquet(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_fixtures(rows: DataFrame, path: str) -> None:
    """Gzipped JSON lines with the bytes of rgb as base64."""
    rows.withColumn("rgb", F.base64("rgb")).write.mode("overwrite").option("compression", "gzip").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Markdown lines (level, line), one text file for each level."""
    lines.select("level", F.col("line").alias("value")).repartition("level").write.mode("overwrite").partitionBy("level").text(path)


def write_ranking(ranked: DataFrame, path: str) -> None:
    """Classes with all their figures as JSON lines, the riskiest first; ``readers.ranking`` reads them again."""
    ranked.orderBy(F.col("risk").desc(), "cls").coalesce(1).write.mode("overwrite").json(path)


def write_truth(timeline: DataFrame, path: str, **about: object) -> None:
    """What was shown at each frame as JSON lines, beside a line of what it was made with."""
    timeline.write.mode("overwrite").json(f"{path}/frames")
    spark = timeline.sparkSession
    spark.createDataFrame([{k: str(v) for k, v in about.items()} or {"version": "1"}]).coalesce(1).write.mode("overwrite").json(f"{path}/about")


def rewrite_manifest(old: DataFrame, new: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """cls, file, new_file of the classes that get another file; the manifest with them is written unless it is a dry run.

    old, new: (cls, file). The manifest is a dimension of a few hundred rows.
    """
    wanted = F.broadcast(new.withColumnRenamed("file", "new_file"))
    changed = old.join(wanted, "cls").where("file <> new_file")
    if not dry_run:
        old.join(wanted, "cls", "left").select("cls", F.coalesce("new_file", "file").alias("file")).coalesce(1).write.mode("overwrite").json(path)
    return changed
