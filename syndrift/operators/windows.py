"""Count-based windows over the frames of a stream, ordered by frame id.

A stream is one partition of the window.  Where one stream holds most frames, ``sliding`` with ``ranges`` cuts its
ids into ranges and copies the last ``depth - 1`` frames of each into the next, so that a single stream spreads
over as many tasks as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import active, fit


def window_row(frames: DataFrame, width: int | None = None) -> DataFrame:
    """The columns that a window needs, events padded or cut to ``width``."""
    events = F.col("events") if width is None else fit(F.col("events"), width)
    more = [c for c in ("ground_truth", "meas", "round", "timestamp_ns") if c in frames.columns]
    return frames.select("stream_id", "frame_id", events.alias("events"), *more)


def flat(rounds: Column) -> Column:
    """The rounds of a window end to end."""
    return F.flatten(rounds)


def active_ids(rounds: Column) -> Column:
    """Fired detectors: round times width plus ancilla."""
    return active(flat(rounds))


def _windowed(rows: DataFrame, depth: int, keys: list[str], full: bool) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("frame_id")
    more = [c for c in ("ground_truth", "_halo") if c in rows.columns]
    rounds = F.collect_list("events").over(order.rowsBetween(1 - depth, 0)).alias("rounds")
    out = rows.select(*keys, "frame_id", *more, rounds, F.row_number().over(order).alias("_n"))
    # full windows by number, not by size, so that a query that needs no rounds does not gather them
    return (out.where(F.col("_n") >= depth) if full else out).drop("_n")


def sliding(frames: DataFrame, depth: int, ranges: int = 1) -> DataFrame:
    """stream_id, end_frame_id, depth, active, rounds (and ground_truth of the newest frame): n - depth + 1 windows of n frames."""
    rows = window_row(frames)
    if ranges > 1:
        rows = _ranged(rows, depth, ranges)
        out = _windowed(rows, depth, ["stream_id", "_range"], True).where(~F.col("_halo")).drop("_halo", "_range")
    else:
        out = _windowed(rows, depth, ["stream_id"], True)
    return out.withColumnRenamed("frame_id", "end_frame_id").withColumn("depth", F.lit(depth)).withColumn("active", active_ids(F.col("rounds")))


def _ranged(rows: DataFrame, depth: int, ranges: int) -> DataFrame:
    """Each stream's frames by range of ids, with the frames before the range as a halo.

    Ranges are equal in ids; the halo takes the last ``depth - 1`` frames of the ids below, found by rank from each
    range's end, from as many ranges back as that needs.
    """
    edges = rows.groupBy("stream_id").agg(F.min("frame_id").alias("_low"), F.max("frame_id").alias("_high"))
    step = F.greatest(F.ceil((F.col("_high") - F.col("_low") + 1) / ranges), F.lit(1))
    own = rows.join(F.broadcast(edges) if edges.limit(1_000_001).count() <= 1_000_000 else edges, "stream_id").withColumn("_range", F.floor((F.col("frame_id") - F.col("_low")) / step).cast("int")).drop("_low", "_high")
    last = Window.partitionBy("stream_id", "_range").orderBy(F.desc("frame_id"))
    tails = own.withColumn("_n", F.row_number().over(last)).where(F.col("_n") < depth).drop("_n")
    # what a range needs from below is at most depth - 1 of the tails of all ranges below, a few rows each
    copies = tails.withColumn("_to", F.explode(F.when(F.col("_range") + 1 < ranges, F.sequence(F.col("_range") + 1, F.lit(ranges - 1)))))
    near = Window.partitionBy("stream_id", "_to").orderBy(F.desc("frame_id"))
    halo = copies.withColumn("_n", F.row_number().over(near)).where(F.col("_n") < depth).drop("_n", "_range").withColumnRenamed("_to", "_range")
    return own.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)))


def growing(frames: DataFrame, depth: int) -> DataFrame:
    """A window after every frame, shorter than ``depth`` at the start of a stream."""
    out = _windowed(window_row(frames), depth, ["stream_id"], False).withColumnRenamed("frame_id", "end_frame_id")
    return out.withColumn("depth", F.size("rounds")).withColumn("active", active_ids(F.col("rounds")))


def auto_depth(detectors: int, ancillas: int) -> int:
    return max(1, detectors // max(ancillas, 1))


def tumbling(frames: DataFrame, depth: int) -> DataFrame:
    """Windows of ``depth`` frames end to end; a last short one is dropped."""
    rows = window_row(frames)
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("frame_id")) - 1
    rows = rows.withColumn("window", F.floor(number / depth))
    truth = [F.max_by("ground_truth", "frame_id").alias("ground_truth")] if "ground_truth" in rows.columns else []
    held = F.array_sort(F.collect_list(F.struct("frame_id", "events")))
    out = rows.groupBy("stream_id", "window").agg(F.max("frame_id").alias("end_frame_id"), *truth, held.alias("rows")).where(F.size("rows") == depth)
    out = out.withColumn("rounds", F.col("rows.events")).drop("rows")
    return out.withColumn("depth", F.lit(depth)).withColumn("active", active_ids(F.col("rounds")))
