"""Calibrations of many streams held in one group give what each gives alone."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstream.operators.calibration import Calibration
from quillstream.operators.ordered import Waiting, in_event_time, mark_of_the_end, to_the_end


def test_a_group_of_calibrations_gives_what_each_gives_alone():
    r = np.random.default_rng(4)
    streams = {k: np.where(r.random(60) < 0.3, -1, (np.arange(60) + 5 * k + (r.random(60) < 0.1)) % 258) for k in range(30)}
    rows = [(k, 2 * i, i, int(c) if c >= 0 else None, 10 * i + k) for k, cls in streams.items() for i, c in enumerate(cls)]
    r.shuffle(rows)
    how = (["stream_id"], ["i"], "_ms", Calibration, 10**6)
    held, out = Waiting(*how), []
    for watermark, part in [(0, [x for x in rows if x[4] <= 300]), (250, [x for x in rows if x[4] > 300]), (10**7, [])]:
        columns = [pa.array([None if v is None else int(v) for v in c], pa.int64()) for c in zip(*part, strict=True)]
        new = pa.table(columns, names=["stream_id", "slot_no", "i", "cls", "_ms"]) if part else None
        out += held.step(new, watermark)
        held = Waiting.restored(held.state(), *how)
    assert not held.own
    for k, cls in streams.items():
        whole = Calibration().feed({"slot_no": 2 * np.arange(60), "i": np.arange(60), "cls": cls})
        assert [x[1:] for x in out if x[0] == k] == whole


def test_a_stream_of_many_keys_has_a_state_for_each_group(spark, tmp_path):
    rows = [(k, 2 * i, i, (i + k) % 258, 1000 * i + k) for k in range(120) for i in range(12)]
    made = spark.createDataFrame(rows, "stream_id bigint, slot_no bigint, i bigint, cls int, ms bigint")
    made = made.select("stream_id", "slot_no", "i", "cls", F.timestamp_millis(F.col("ms") + 1_700_000_000_000).alias("at"))
    made.repartition(3).write.parquet(f"{tmp_path}/feed")
    mark_of_the_end(made, "at").write.parquet(f"{tmp_path}/ends")
    feed = spark.readStream.schema(made.schema).parquet(f"{tmp_path}/feed")
    found = in_event_time(to_the_end(feed, "at", f"{tmp_path}/ends"), ["stream_id"], "at", ["i"], Calibration, "stream_id bigint, slot_no bigint, i bigint, got int, expected int", groups=5)
    writer = found.writeStream.format("memory").queryName("calibrated").option("checkpointLocation", f"{tmp_path}/state")
    run = writer.outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    states = [s["numRowsTotal"] for p in run.recentProgress for s in p["stateOperators"]]
    assert states and max(states) == 5
    got = sorted(map(tuple, spark.table("calibrated").collect()))
    assert got == [(k, 2 * i, i, (i + k) % 258, (i + k) % 258) for k in range(120) for i in range(1, 12)]
