"""Machines over the rows of each key in order, fed with arrays, in batch and in streams.

A machine has ``feed(columns) -> rows`` and ``close() -> rows``; columns are numpy arrays by name, and rows are tuples that
follow the key; or ``feeding`` and ``closing``, which ask for searches (``reception.answered``) that are made together for many
keys. It is given as much of a key's rows as a batch holds, so what a task holds is one machine and one batch. In a stream, a task
holds the machines of a group of keys.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from ..shipping import ship
from .reception import Asking, answered

#: A key that is silent for this long before the watermark is over (ms).
IDLE_MS = 60_000


def array_of(column: pa.Array) -> np.ndarray:
    """Numbers without nulls as they are; a null whole number as -1, any other null as NaN or None."""
    if column.null_count and pa.types.is_integer(column.type):
        column = column.fill_null(-1)
    return column.to_numpy(zero_copy_only=False)


def _starts(batch: pa.RecordBatch, key: list[str]) -> list[int]:
    """Where the key changes within a batch."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in key:
        code = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new).tolist()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _by_key(batch: pa.RecordBatch, key: list[str], skip: tuple[str, ...] = ()) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Each stretch of one key: the key, and the other columns but those of ``skip``."""
    columns = {c: array_of(batch.column(c)) for c in batch.schema.names if c not in key and c not in skip}
    starts = _starts(batch, key)
    keys = zip(*(batch.column(c).take(pa.array(starts)).to_pylist() for c in key), strict=True)
    for k, a, b in zip(keys, starts, [*starts[1:], batch.num_rows], strict=True):
        yield k, {c: v[a:b] for c, v in columns.items()}


#: Keys, and rows, that are worked on together.
KEYS_TOGETHER, ROWS_TOGETHER = 512, 100_000


def _work(own, parts: list[dict[str, np.ndarray]], ends: bool) -> Asking:
    """Feeds a machine, and closes it if that is all; returns its rows."""
    out: list[tuple] = []
    asks = hasattr(own, "feeding")
    for c in parts:
        out += (yield from own.feeding(c)) if asks else own.feed(c)
    if ends:
        out += (yield from own.closing()) if asks else own.close()
    return out


def _worked(jobs: list[tuple[tuple, Asking]]) -> list[tuple]:
    """The rows of all jobs, each behind its key."""
    return [(*k, *x) for (k, _), found in zip(jobs, answered([w for _, w in jobs]), strict=True) for x in found]


def in_order(rows: DataFrame, key: list[str], order: list[str], machine: Callable, schema: str) -> DataFrame:
    """The output of a machine for each key, over its rows sorted by ``order``. schema: the key's columns, then the machine's."""
    ship(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Keys that are whole, and the one in progress: its machine, and what it is not fed yet.
        jobs: list[tuple[tuple, Asking]] = []
        now, own, parts, held = None, None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for k, columns in _by_key(batch, key):
                if own is None or k != now:
                    jobs += [(now, _work(own, parts, True))] if own else []
                    now, own, parts = k, machine(), []
                parts.append(columns)
            held += batch.num_rows
            if held >= ROWS_TOGETHER or len(jobs) >= KEYS_TOGETHER:
                yield _batch(_worked([*jobs, (now, _work(own, parts, False))]), given)
                jobs, parts, held = [], [], 0
        if own:
            yield _batch(_worked([*jobs, (now, _work(own, parts, True))]), given)

    return rows.repartition(parts, *key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


#: Into how many groups the keys of a stream are dealt. A group is one call and one state; with a call and a state for each key
#: these would take longer than the work in them.
GROUPS = 1024


class Waiting:
    """The keys of a group: machines, when each is over, and the rows that wait for the watermark."""

    def __init__(self, key: list[str], order: list[str], clock: str, machine: Callable, idle_ms: int):
        self.key, self.order, self.clock, self.machine, self.idle_ms = key, order, clock, machine, idle_ms
        self.own: dict[tuple, list] = {}  # machine (None before its first row is fed), and the time after which its key is over
        self.rows: pa.Table | None = None

    @staticmethod
    def restored(state: bytes, key: list[str], order: list[str], clock: str, machine: Callable, idle_ms: int) -> Waiting:
        out = Waiting(key, order, clock, machine, idle_ms)
        out.own, rows = pickle.loads(state)
        out.rows = pa.ipc.open_stream(rows).read_all() if rows else None
        return out

    def state(self) -> bytes:
        sink = pa.BufferOutputStream()
        if self.rows is not None:
            with pa.ipc.new_stream(sink, self.rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(self.rows)
        return pickle.dumps((self.own, sink.getvalue().to_pybytes()))

    def step(self, new: pa.Table | None, watermark: int) -> list[tuple]:
        """Takes rows; feeds what the watermark has passed, and closes keys that it leaves behind without new rows."""
        fresh = set()
        if new is not None and new.num_rows:
            last = new.select([*self.key, self.clock]).group_by(self.key).aggregate([(self.clock, "max")])
            for *k, at in zip(*(last.column(c).to_pylist() for c in (*self.key, f"{self.clock}_max")), strict=True):
                k = tuple(k)
                fresh.add(k)
                held = self.own.setdefault(k, [None, 0])
                held[1] = max(held[1], max(at, watermark) + self.idle_ms)
            self.rows = new if self.rows is None else pa.concat_tables([self.rows, new])
        out: list[tuple] = []
        jobs: list[tuple[tuple, Asking]] = []
        over = {k for k, (_, end) in self.own.items() if end < watermark and k not in fresh}
        if self.rows is not None:
            ripe = pc.less_equal(self.rows.column(self.clock), watermark)
            batch = self.rows.filter(ripe).sort_by([(c, "ascending") for c in (*self.key, *self.order)]).combine_chunks()
            self.rows = left if (left := self.rows.filter(pc.invert(ripe))).num_rows else None
            for part in batch.to_batches():
                for k, columns in _by_key(part, self.key, (self.clock,)):
                    held = self.own[k]
                    held[0] = held[0] or self.machine()
                    jobs.append((k, _work(held[0], [columns], k in over)))  # a key's rows are one stretch, as they are sorted
                    if k in over:
                        over.remove(k)
                        del self.own[k]
                    if len(jobs) >= KEYS_TOGETHER // 2:
                        out += _worked(jobs)
                        jobs = []
        jobs += [(k, _work(own, [], True)) for k in over if (own := self.own.pop(k)[0])]
        return out + _worked(jobs)


def in_event_time(rows: DataFrame, key: list[str], clock: str, order: list[str], machine: Callable, schema: str, idle_ms: int = IDLE_MS, groups: int = GROUPS) -> DataFrame:
    """As ``in_order`` for a stream that has a watermark on the timestamp column ``clock``.

    Rows wait in the state until the watermark has passed them, so rows that come late, or in another order than that of
    their times, are fed in order as long as the watermark allows them. A key that stays silent for idle_ms of event time is
    closed, and its state goes. Rows whose key begins with null are not looked at.

    Keys are dealt into groups by their hash: a task holds one group at a time, and its rows that wait. ``groups`` must stay
    as it is for a stream that goes on from a checkpoint.
    """
    ship(rows.sparkSession)
    given = to_arrow_schema(StructType.fromDDL(schema))
    names = [f.name for f in given]
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema)}
    dtype = {"int": "Int32", "bigint": "Int64", "boolean": "boolean", "double": "float64"}
    passed = [c for c in rows.columns if c != clock]
    taken = pa.schema([f for f in to_arrow_schema(rows.schema) if f.name != clock] + [pa.field("_ms", pa.int64())])

    def table(found: list[tuple]) -> pd.DataFrame:
        by_name = dict(zip(names, zip(*found, strict=True), strict=True))
        return pd.DataFrame({c: pd.Series(list(v), dtype=dtype.get(kinds[c], "object")) for c, v in by_name.items()})

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        how = (key, order, "_ms", machine, idle_ms)
        held = Waiting.restored(state.get[0], *how) if state.exists else Waiting(*how)
        now, new = state.getCurrentWatermarkMs(), None
        if not state.hasTimedOut:
            # a mark of the end: no filter before the watermark may take it away, or the watermark would not move
            known = (x[x[key[0]].notna()] for x in frames)
            parts = [pa.Table.from_pandas(x[taken.names], schema=taken, preserve_index=False) for x in known if len(x)]
            new = pa.concat_tables(parts) if parts else None
        out = held.step(new, now)
        if held.own:
            state.update((held.state(),))
            state.setTimeoutTimestamp(max(now + 1, min(end for _, end in held.own.values())))
        elif state.exists:
            state.remove()
        if out:
            yield table(out)

    # Where a null makes numbers of a key to floating point ones on the way, it does so among its likes only.
    group = F.pmod(F.xxhash64(*key), F.lit(groups))
    whole = F.lit(True)
    for c in key:
        whole &= F.col(c).isNotNull()
    dealt = rows.select(F.when(whole, group).otherwise(-1 - group).alias("_group"), *passed, F.unix_millis(clock).alias("_ms"), clock)
    return dealt.groupBy("_group").applyInPandasWithState(step, schema, "machine binary", "append", "EventTimeTimeout")


def to_the_end(rows: DataFrame, clock: str, ends: str) -> DataFrame:
    """``rows`` and the marks in the folder ``ends``: rows of nulls but for their time, which move the watermark on."""
    marks = rows.sparkSession.readStream.schema(rows.schema).parquet(ends)
    return rows.unionByName(marks).withWatermark(clock, "2 seconds")


def mark_of_the_end(rows: DataFrame, clock: str) -> DataFrame:
    """One row, later than any."""
    spark = rows.sparkSession
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != clock]
    return spark.range(1).select(*none, F.lit("2200-01-01 00:00:00").cast("timestamp").cast(rows.schema[clock].dataType).alias(clock)).select(*rows.columns)
