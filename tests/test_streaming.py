import json
import os

import pytest
from pyspark.sql import functions as F

from syndrift.operators import validate, windows
from syndrift.sources import frames
from syndrift.streaming import stateful


def test_tail_of_a_folder(spark, tmp_path):
    base = frames.synthetic(spark, 60, 0.05)
    frames.write(base.coalesce(1), str(tmp_path / "in"))
    got = stateful.drain(stateful.read_stream(spark, str(tmp_path / "in")))
    assert got.where("error is null").select("frame_id", "events").exceptAll(base.select("frame_id", "events")).count() == 0 and got.count() == 60


def test_state_carries_over_batches(spark, tmp_path):
    base = frames.synthetic(spark, 90, 0.05).withColumn("stream_id", (F.col("frame_id") % 2).cast("string"))
    for k in range(3):
        base.where(F.floor(F.col("frame_id") / 30) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    parts = sorted((p for p in (tmp_path / "in").glob("*.parquet")), key=lambda p: spark.read.parquet(str(p)).agg(F.min("frame_id")).first()[0])
    for k, p in enumerate(parts):
        os.utime(p, (1000 + k, 1000 + k))
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = stateful.drain(stateful.sliding(stream, 4)).select("stream_id", "end_frame_id", "active")
    assert sorted(got.collect()) == sorted(windows.sliding(base, 4).select("stream_id", "end_frame_id", "active").collect())
    ordered = stateful.drain(stateful.check_order(stream))
    assert ordered.count() == 90 and ordered.where("not in_order").count() == 0
    held = []
    query = stateful.replay(spark, str(tmp_path / "in"), base._jdf.schema().toDDL(), lambda b, n: held.append(b.count()))
    query.awaitTermination(60)
    assert held == [30, 30, 30]


def test_late_events_are_dropped(spark, tmp_path):
    rows = [(0, 0), (1, 100), (2, 101), (3, 1)]  # the watermark of one batch drops from the next but one
    for k, (i, t) in enumerate(rows):
        (tmp_path / f"{k}.json").write_text(json.dumps({"stream_id": "s", "events": [True, False], "ts": f"2024-01-01T00:{t // 60:02}:{t % 60:02}Z"}))
        os.utime(tmp_path / f"{k}.json", (1000 + k, 1000 + k))
    stream = spark.readStream.schema("stream_id string, events array<boolean>, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    got = stateful.drain(stateful.event_time_counts(stream, "ts", "10 seconds", "5 seconds"))
    assert got.agg(F.sum("frames")).first()[0] == 1


def test_fan_out(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    a, b = [], []
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    q = stateful.fan_out(stream, [lambda d, n: a.append(d.count()), lambda d, n: b.append(d.agg(F.sum("id")).first()[0])]).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert (a, b) == ([5], [10])


def test_progress(spark, tmp_path):
    import time

    from syndrift.streaming.progress import Progress

    spark.range(40).write.parquet(str(tmp_path / "in"))
    seen = Progress()
    spark.streams.addListener(seen)
    try:
        stateful.drain(spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")))
        for _ in range(100):
            if seen.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert seen.summary()["rows"] == 40 and list(seen.ended.values()) == [None]


@pytest.fixture
def small_parts(spark):
    """A stream's frames reach Python in parts of seven."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, held)


def _scattered(spark, rows, path):
    """The rows as a stream of three files, each against the order of ids."""
    rows.repartition(3).sortWithinPartitions(F.desc("frame_id")).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def test_order_over_parts(spark, small_parts, tmp_path):
    i = F.col("id")
    rows = spark.range(200).select((i % 2).cast("string").alias("stream_id"), (i + (1 << 60)).alias("frame_id"), (i + F.when(i % 10 == 0, 60).otherwise(0)).alias("arrival"))
    got = stateful.drain(stateful.check_order(_scattered(spark, rows, str(tmp_path / "in"))))
    want = validate.out_of_order(rows).drop("arrival").select(got.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.where("not in_order").count() == 20


def test_order_of_a_missing_id(spark, small_parts, tmp_path):
    rows = spark.createDataFrame([("s", (1 << 60) + 1, 1), ("s", None, 2), ("s", (1 << 60) + 2, 3), ("s", 5, 4)], "stream_id string, frame_id bigint, arrival bigint")
    got = stateful.drain(stateful.check_order(_scattered(spark, rows, str(tmp_path / "in")))).drop("stream_id")
    top = (1 << 60) + 1
    assert {tuple(r) for r in got.collect()} == {(top, None, True), (None, top, True), (top + 1, top, True), (5, top + 1, False)}


def test_windows_over_parts(spark, small_parts, tmp_path):
    i = F.col("id")
    events = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda j: (i + j) % 9 == 0)
    truth = F.when(i % 5 > 0, i + (1 << 60)).alias("ground_truth")
    rows = spark.range(201).select((i % 2).cast("string").alias("stream_id"), (i + (1 << 60)).alias("frame_id"), events.alias("events"), truth)
    stream, cols = _scattered(spark, rows, str(tmp_path / "in")), ["stream_id", "end_frame_id", "depth", "active", "ground_truth"]
    for got, want in [(stateful.sliding(stream, 4), windows.sliding(rows, 4)), (stateful.sliding(stream, 4, growing=True), windows.growing(rows, 4))]:
        assert sorted(stateful.drain(got).collect(), key=repr) == sorted(want.select(cols).collect(), key=repr)


def test_windows_of_repeated_ids(spark, small_parts, tmp_path):
    rows = spark.sql("select 's' as stream_id, a.id as frame_id, array(a.id % 2 = 0, true) as events from range(20) a, range(3) b")
    stream, cols = _scattered(spark, rows, str(tmp_path / "in")), ["end_frame_id", "active"]
    want = [windows.sliding(x, 4).select(cols).collect() for x in (rows, rows.distinct())]
    got = [stateful.drain(stateful.sliding(stream, 4, repeats=x)).select(cols).collect() for x in (True, False)]
    assert list(map(sorted, got)) == list(map(sorted, want)) and len(got[0]) == 57


def test_windows_leave_late_frames_out(spark, small_parts, tmp_path):
    for k, ids in enumerate([[1, 2, 5, 6], [3, 4], [6, 7, None, 8]]):
        spark.createDataFrame([("s", i, [True, (i or 0) % 2 == 0]) for i in ids], "stream_id string, frame_id bigint, events array<boolean>").coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
        for p in (tmp_path / "in" / f"k={k}").glob("*.parquet"):
            os.utime(p, (1000 + k, 1000 + k))
    stream = spark.readStream.schema("stream_id string, frame_id bigint, events array<boolean>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = stateful.drain(stateful.sliding(stream, 3)).collect()
    assert sorted((r.end_frame_id, r.active, r.ground_truth) for r in got) == [(5, [0, 2, 3, 4], 0), (6, [0, 1, 2, 4, 5], 0), (7, [0, 2, 3, 4], 0), (8, [0, 1, 2, 4, 5], 0)]
