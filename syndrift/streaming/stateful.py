"""Structured Streaming: order checks, count windows, rolling metrics and paced replay.

State is kept for each stream: the last id, or the last ``depth`` frames.  An out-of-order frame is set aside
with an error and the query goes on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.bits import active
from ..session import shared_dir

#: Stands for a missing id on the way through numpy; lies below every id.
NONE = -(2**63)
#: Rows that leave Python at once.
PIECE = 10_000


def read_stream(spark: SparkSession, path: str, terminator: str = "header") -> DataFrame:
    """Frames of a folder, or of tcp://host:port, as they arrive."""
    from ..sources.frames import register

    register(spark)
    return spark.readStream.format("frames").option("terminator", terminator).load(path)


def check_order(frames: DataFrame) -> DataFrame:
    """stream_id, frame_id, last_id, in_order: frames must arrive with growing ids; rejected ones leave the state as it is.

    A stream's frames reach Python in several parts, in any order, so all of a batch are gathered (as two numbers a
    frame) and put in order of ``arrival``.  Without that column they count as Spark delivers them.
    """
    timed = "arrival" in frames.columns

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [(p["frame_id"].to_numpy(), p["arrival"].to_numpy() if timed else None) for p in parts]
        ids = np.concatenate([x for x, _ in held])
        if timed:
            ids = ids[np.argsort(np.concatenate([t for _, t in held]), kind="stable")]
        # the last id taken is the largest so far
        last = np.maximum.accumulate(np.concatenate([[state.get[0] if state.exists else NONE], ids]))
        for k in range(0, len(ids), PIECE):
            own, before = ids[k : k + PIECE], last[k : min(k + PIECE, len(ids))]
            fid, lid = (pd.arrays.IntegerArray(x, x == NONE) for x in (own, before))
            yield pd.DataFrame({"stream_id": key[0], "frame_id": fid, "last_id": lid, "in_order": (own > before) | (own == NONE)})
        if last[-1] != NONE:
            state.update((int(last[-1]),))

    fid = F.coalesce(F.col("frame_id").cast("bigint"), F.lit(NONE)).alias("frame_id")
    return frames.select("stream_id", fid, *(["arrival"] if timed else [])).groupBy("stream_id").applyInPandasWithState(step, "stream_id string, frame_id bigint, last_id bigint, in_order boolean", "last bigint", "append", GroupStateTimeout.NoTimeout)


def sliding(frames: DataFrame, depth: int, growing: bool = False, repeats: bool = False) -> DataFrame:
    """stream_id, end_frame_id, depth, active and ground_truth of every window as its newest frame arrives.

    All frames of a batch are gathered for each stream, as numbers of fired detectors, and put in order of their ids.
    Frames whose id does not exceed the last one taken are left out, as in ``check_order``, and so are frames without
    an id; with ``repeats`` frames of an equal id are taken, as by ``windows.sliding``.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held, width = state.get if state.exists else (None, [], None)
        names = ["frame_id", "width", "ground_truth", "known"]
        own = [([p[c].to_numpy() for c in names], p["fired"].map(len).to_numpy(), np.concatenate(p["fired"].tolist())) for p in parts]
        ids, widths, truth, known = (np.concatenate(x) for x in zip(*(x for x, _, _ in own), strict=True))
        sizes, fired = np.concatenate([x for _, x, _ in own]), np.concatenate([x for _, _, x in own])
        del own
        order = np.argsort(ids, kind="stable")
        if not repeats:
            order = order[np.concatenate([[True], np.diff(ids[order]) != 0])]
        if last is not None:
            order = order[ids[order] >= last if repeats else ids[order] > last]
        if not len(order):
            return
        # the fired detectors of all rounds end to end: first those held, then the batch's by id
        n, starts = len(held), np.cumsum(sizes) - sizes
        sizes, starts, ids, widths, truth, known = (x[order] for x in (sizes, starts, ids, widths, truth, known))
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        fired = np.concatenate([*(np.array(x, "int64") for x in held), fired[at].astype("int64")])
        sizes = np.concatenate([np.array([len(x) for x in held], "int64"), sizes])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        width = width or int(widths[np.argmax(widths > 0)])
        placed = fired + width * np.repeat(np.arange(len(sizes)), sizes)
        for k in range(0, len(ids), PIECE):
            end = np.arange(n + k, min(n + k + PIECE, len(sizes))) + 1
            end = end if growing else end[end >= depth]
            if len(end):
                low, row = np.maximum(end - depth, 0), end - 1 - n
                rounds = [placed[edges[a] : edges[b]] - width * a for a, b in zip(low.tolist(), end.tolist(), strict=True)]
                yield pd.DataFrame({"stream_id": key[0], "end_frame_id": ids[row], "depth": end - low, "active": rounds, "ground_truth": pd.arrays.IntegerArray(truth[row], ~known[row])})
        state.update((int(ids[-1]), [fired[a:b].tolist() for a, b in zip(edges[:-1][-depth:], edges[1:][-depth:], strict=True)], width))

    truth = (F.col("ground_truth") if "ground_truth" in frames.columns else F.lit(0)).cast("bigint")
    own = frames.where("frame_id is not null").select(
        "stream_id", "frame_id", F.size("events").alias("width"), active(F.col("events")).alias("fired"), F.coalesce(truth, F.lit(0)).alias("ground_truth"), truth.isNotNull().alias("known")
    )
    return own.groupBy("stream_id").applyInPandasWithState(
        step, "stream_id string, end_frame_id bigint, depth int, active array<int>, ground_truth bigint", "last bigint, rounds array<array<int>>, width int", "append", GroupStateTimeout.NoTimeout
    )


def running_rates(windows: DataFrame) -> DataFrame:
    """stream_id, shots, errors of decoded windows so far (complete mode)."""
    wrong = (F.col("observable_flips") != F.coalesce("ground_truth", F.lit(0))).cast("bigint")
    return windows.groupBy("stream_id").agg(F.count("*").alias("shots"), F.sum(wrong).alias("errors"))


def event_time_counts(frames: DataFrame, time: str, window: str, delay: str) -> DataFrame:
    """Frames and fired detectors by event-time window; frames later than ``delay`` are dropped."""
    fired = F.size(F.filter("events", lambda e: e))
    return frames.withWatermark(time, delay).groupBy("stream_id", F.window(time, window).alias("w")).agg(F.count("*").alias("frames"), F.sum(fired).alias("fired"))


def replay(spark: SparkSession, path: str, schema: str, each: Callable[[DataFrame, int], None], files_per_trigger: int = 1, interval: str | None = None):
    """Paced replay of a folder of Parquet frames: ``each`` gets every batch, at most one an interval."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    out = rows.writeStream.foreachBatch(each)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()


def fan_out(frames: DataFrame, sinks: list[Callable[[DataFrame, int], None]]):
    """One stream to several sinks, each batch read once."""

    def each(batch: DataFrame, n: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, n)
        batch.unpersist()

    return frames.writeStream.foreachBatch(each)


def drain(df: DataFrame, mode: str = "append", timeout: float | None = None) -> DataFrame:
    """All that a bounded stream gives, by way of files in the shared folder.

    Every batch overwrites a folder of its own, so one that runs twice counts once.  In complete mode the last batch is
    the result.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/syndrift/stream-{uuid.uuid4().hex}"
    seen: list[int] = []

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={n}")
        seen.append(n)

    query = df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    try:
        if not query.awaitTermination(timeout) and timeout:
            raise TimeoutError(f"the stream ran for more than {timeout} s")
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    if not seen:
        return spark.createDataFrame([], df.schema)
    rows = spark.read.schema(df.schema)
    return rows.parquet(f"{at}/rows/batch={max(seen)}") if mode == "complete" else rows.parquet(*(f"{at}/rows/batch={n}" for n in seen))
