"""Placement of documents by a permutation-filled lookup table (operator 5).

Every shard has its own order of preference over the slots of a prime-sized table; the shards take turns, each claiming
the first slot in its order that is still free, until all slots are taken. A key then goes to slot ``hash(key) mod size``
and to that slot's shard. Loads differ by at most one slot, and if a shard is added or removed few keys move.

The table has ``size`` rows whatever the corpus, so it is broadcast. Keys are hashed one row at a time in the JVM: no
shuffle, and a hot source is spread like any other rows. A null key is hashed as a key of its own; repeated keys go to
the same shard; an empty table gives no rows; other columns are carried unless they clash, then the operator's win.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .members import fresh

#: A prime, over 100 slots for each of up to 600 shards.
TABLE_SIZE = 65_537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """slot -> number of its shard."""
    if not shards or len(shards) > size:
        raise ValueError("there must be from 1 to size shards")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be prime, or the preference orders would not reach every slot")
    place = [_number(f"offset:{s}") % size for s in shards]
    stride = [_number(f"stride:{s}") % (size - 1) + 1 for s in shards]
    table = np.full(size, -1, np.int64)
    taken = 0
    while True:
        for k in range(len(shards)):
            slot = place[k]
            while table[slot] >= 0:
                slot = (slot + stride[k]) % size
            table[slot] = k
            place[k] = (slot + stride[k]) % size
            taken += 1
            if taken == size:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The first 60 bits of the key's MD5, modulo the table's size."""
    word = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\\N"))), 1, 15), 16, 10).cast("bigint")
    return F.pmod(word, F.lit(size))


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    names = np.array(shards, dtype=object)
    table = lookup_table(shards, size)
    return spark.createDataFrame(list(zip(range(size), table.tolist(), names[table].tolist(), strict=True)), "slot bigint, shard_no bigint, shard string")


def placed(df: DataFrame, shards: list[str], *, key_col: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with slot, shard_no and shard. A key column of one of these names is hashed before it gives way."""
    held = fresh("slot_held", df)
    keys = df.withColumn(held, slot_of(F.col(key_col), size)).drop("slot", "shard_no", "shard").withColumnRenamed(held, "slot")
    return keys.join(F.broadcast(table_frame(df.sparkSession, shards, size)), "slot")


def loads(placements: DataFrame) -> DataFrame:
    return placements.groupBy("shard_no", "shard").agg(F.count("*").alias("n_docs"))
