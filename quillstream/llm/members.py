"""A fixed-size bitmap of keys, to leave rows out of a shuffle that cannot meet any of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 MB, whatever the number of keys. With very many keys it fills up and leaves out fewer rows; results stay the same.
BITS = 1 << 24
_PAGE = 1 << 14


def _pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: dict[int, np.ndarray] = {}
    for frame in frames:
        for page, bits in frame.groupby("page")["bit"]:
            np.logical_or.at(found.setdefault(int(page), np.zeros(_PAGE, bool)), bits.to_numpy(), True)
    yield pd.DataFrame({"page": list(found), "bits": [np.packbits(x).tobytes() for x in found.values()]})


def bitmap(keys: DataFrame, column: str):
    """A broadcast of BITS bits; each task folds its keys into pages of 2 KB before anything is sent."""
    at = F.pmod(F.col(column), F.lit(BITS))
    pages = keys.select(F.floor(at / _PAGE).cast("int").alias("page"), F.pmod(at, F.lit(_PAGE)).cast("int").alias("bit")).distinct().repartition("page").mapInPandas(_pages, "page int, bits binary")
    whole = np.zeros(BITS // 8, np.uint8)
    found = pages.toArrow()  # one row for each page, whatever the number of keys
    for page, bits in zip(found.column("page").to_pylist(), found.column("bits").to_pylist(), strict=True):
        part = whole[page * _PAGE // 8 : (page + 1) * _PAGE // 8]
        np.bitwise_or(part, np.frombuffer(bits, np.uint8), out=part)
    return keys.sparkSession.sparkContext.broadcast(whole)


def held_in(bits, keys: np.ndarray) -> np.ndarray:
    """True for every key of the bitmap, and for few others."""
    at = np.mod(keys, BITS)
    return (bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def may_be_in(bits, key: Column) -> Column:
    """As ``held_in``, for a column."""

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(held_in(bits, keys.to_numpy(np.int64, na_value=0)))

    return test(F.coalesce(key, F.lit(0)))


def only(batches: Iterator[pa.RecordBatch], bits, key: str, wanted: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose key (never null) is in the bitmap, or is not; for use inside a task that runs Python anyhow."""
    for batch in batches:
        yield batch.filter(pa.array(held_in(bits, batch.column(key).to_numpy()) == wanted))


def rows_in(rows: DataFrame, bits, key: str) -> DataFrame:
    return rows.mapInArrow(lambda batches: only(batches, bits, key, True), rows.schema)


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs``, all columns, whose key is not among those of ``gone`` (its only column). Rows that cannot be are not shuffled.

    gone has a whole number in its column, never null; a row without a key stays.
    """
    may, other = fresh("may", docs), fresh("gone", docs)
    flagged = docs.withColumn(may, may_be_in(bitmap(gone, gone.columns[0]), F.col(key)))
    stay = flagged.where(F.col(may)).join(gone.toDF(other), F.col(key) == F.col(other), "left_anti")
    return flagged.where(~F.col(may)).unionByName(stay).drop(may)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever its case."""
    used = {c.lower() for f in frames for c in f.columns}
    while name in used:
        name += "_"
    return name
