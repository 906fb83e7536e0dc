"""Rates, histograms and reports over frames and decoded windows.  All aggregate before they shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import weight


def share(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binomial_error(p: Column, n: Column) -> Column:
    return F.when(n > 0, F.sqrt(p * (1 - p) / n)).otherwise(F.lit(0.0))


def logical_errors(decoded: DataFrame, observables: int = 1, by: list[str] | None = None) -> DataFrame:
    """observable, shots, errors, rate: how often the prediction and the truth differ in each observable (at most 64)."""
    n = min(observables, 64)
    wrong = F.col("observable_flips").bitwiseXOR(F.coalesce("ground_truth", F.lit(0).cast("bigint")))
    sums = [F.sum(F.getbit(wrong, F.lit(i)).cast("bigint")).alias(f"e{i}") for i in range(n)]
    one = decoded.groupBy(*(by or [])).agg(F.count("*").alias("shots"), *sums)
    rows = one.select(*(by or []), "shots", F.posexplode(F.array(*(F.coalesce(f"e{i}", F.lit(0)) for i in range(n)))).alias("observable", "errors")) if n else one.select(*(by or []), "shots", F.lit(0).alias("observable"), F.lit(0).cast("bigint").alias("errors")).where("false")
    return rows.withColumn("rate", share(F.col("errors"), F.col("shots")))


def mean_rate(rates: DataFrame) -> DataFrame:
    return rates.agg(F.coalesce(F.avg("rate"), F.lit(0.0)).alias("mean_p_l"))


def below_threshold(report: DataFrame, limit: float) -> DataFrame:
    return report.where(F.col("mean_p_l") < limit)


#: Up to so many ancillas are summed as columns, in one pass of compiled code; more are exploded into rows.
WIDE = 256
#: Up to so many, frequencies and weights are taken in one pass.
ONE_PASS = 64


def _bit(j: int) -> Column:
    return F.coalesce(F.get("events", F.lit(j)), F.lit(False)).cast("bigint")


def _weight(width: int) -> Column:
    w = weight(F.col("events"))
    if not 0 < width <= WIDE:
        return w
    return F.when(F.size("events") <= width, reduce(Column.__add__, (_bit(j) for j in range(width))).cast("int")).otherwise(w)


def fire_frequency(frames: DataFrame, width: int | None = None, by: list[str] | None = None) -> DataFrame:
    """ancilla, fires, frames, frequency: over all frames; ancillas past ``width`` (or the first frame's) do not count."""
    keys = by or []
    if width and width <= WIDE:
        sums = [F.sum(_bit(j)).alias(f"s{j}") for j in range(width)]
        one = frames.groupBy(*keys).agg(F.count("*").alias("frames"), *sums).select(*keys, "frames", F.posexplode(F.array(*(F.coalesce(f"s{j}", F.lit(0).cast("bigint")) for j in range(width)))).alias("ancilla", "fires"))
        return one.select(*keys, "ancilla", "fires", "frames", share(F.col("fires"), F.col("frames")).alias("frequency"))
    totals = frames.groupBy(*keys).agg(F.count("*").alias("frames"), F.min_by(F.size("events"), "frame_id").alias("width"))
    cells = frames.select(*keys, F.posexplode("events").alias("ancilla", "e")).groupBy(*keys, "ancilla").agg(F.sum(F.col("e").cast("bigint")).alias("fires"))
    all_ = totals.select(*keys, "frames", F.explode(F.sequence(F.lit(0), (F.lit(width) if width else F.col("width")) - 1)).alias("ancilla")).where("ancilla >= 0")
    out = all_.join(cells, [*keys, "ancilla"], "left").withColumn("fires", F.coalesce("fires", F.lit(0).cast("bigint")))
    return out.select(*keys, "ancilla", "fires", "frames", share(F.col("fires"), F.col("frames")).alias("frequency"))


def weight_histogram(frames: DataFrame, width: int) -> DataFrame:
    """weight 0..width and frames: dense; heavier frames are dropped."""
    counts = frames.select(_weight(width).alias("weight")).groupBy("weight").agg(F.count("*").alias("n"))
    dense = frames.sparkSession.range(width + 1).select(F.col("id").cast("int").alias("weight"))
    return dense.join(counts, "weight", "left").select("weight", F.coalesce("n", F.lit(0)).alias("frames"))


def power_bucket(value: Column, buckets: int) -> Column:
    """Bucket of a power-of-two histogram: 0 and 1 in the first, the last takes the rest; by bit length, without floats."""
    return F.least(F.when(value > 0, F.length(F.bin(value)) - 1).otherwise(0), F.lit(buckets - 1))


def power_histogram(values: DataFrame, column: str, buckets: int) -> DataFrame:
    return values.groupBy(power_bucket(F.col(column), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def nearest_rank(values: DataFrame, column: str, percent: int) -> DataFrame:
    """The ceil(n p / 100)-th smallest value; 0 of none."""
    kind = values.schema[column].dataType
    return values.agg(F.coalesce(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {column})"), F.lit(0)).cast(kind).alias("value"))


#: Ranges of values in which ranks are counted.
RANGES = 1000


def floor_rank(values: DataFrame, column: str, percent: int) -> DataFrame:
    """The value at place floor(n p / 100) from 0, the last at most.

    Places come from counts by value, summed first by range of values and then inside ranges, so no task sorts all
    distinct values.
    """
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("all"), F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high"))
    place = F.coalesce(F.floor(F.try_divide(F.col("v").cast("double") - F.col("low"), F.col("high") - F.col("low")) * RANGES), F.when(F.col("v").isNull(), F.lit(-1)).otherwise(F.lit(0)))
    counts = counts.join(F.broadcast(whole)).withColumn("place", place)
    ranges = counts.groupBy("place").agg(F.sum("n").alias("own"))
    ranges = ranges.select("place", (F.sum("own").over(Window.orderBy("place")) - F.col("own")).alias("ahead"))
    upto = counts.join(F.broadcast(ranges), "place").withColumn("upto", F.col("ahead") + F.sum("n").over(Window.partitionBy("place").orderBy("v")))
    at = F.least(F.floor(F.col("all") * percent / 100), F.col("all") - 1)
    return upto.where(F.col("upto") > at).agg(F.coalesce(F.min("v"), F.lit(0)).alias("value"))


def latency(rows: DataFrame, column: str = "latency_ns") -> DataFrame:
    """Whole mean, maximum, and nearest-rank median and 99th percentile."""
    kind = rows.schema[column].dataType
    rank = lambda p: F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})"), F.lit(0)).cast(kind)
    mean = F.coalesce(F.expr(f"sum({column}) div nullif(count({column}), 0)"), F.lit(0))
    return rows.agg(mean.alias("mean"), F.coalesce(F.max(column), F.lit(0)).alias("max"), rank(0.5).alias("p50"), rank(0.99).alias("p99"))


def weight_stats(frames: DataFrame) -> DataFrame:
    w = weight(F.col("events"))
    return frames.agg(F.avg(w).alias("mean"), F.stddev_pop(w).alias("std"), F.max(w).alias("max"), (F.sum(w) / F.sum(F.size("events"))).alias("rate"))


def _cell_counts(frames: DataFrame, width: int) -> DataFrame:
    """One row: frames, fire_frequency and weight_histogram."""
    if not 0 < width <= ONE_PASS:
        freq = fire_frequency(frames, width).agg(F.transform(F.array_sort(F.collect_list(F.struct("ancilla", "frequency"))), lambda x: x["frequency"]).alias("fire_frequency"))
        hist = weight_histogram(frames, width).agg(F.transform(F.array_sort(F.collect_list(F.struct("weight", "frames"))), lambda x: x["frames"]).alias("weight_histogram"))
        return frames.agg(F.count("*").alias("frames")).join(F.broadcast(freq)).join(F.broadcast(hist))
    cells = frames.select(*(_bit(j).alias(f"b{j}") for j in range(width)), _weight(width).alias("w"))
    sums = [F.sum(f"b{j}").alias(f"s{j}") for j in range(width)]
    one = cells.agg(F.count("*").alias("frames"), *sums, *(F.count_if(F.col("w") == k).alias(f"h{k}") for k in range(width + 1)))
    freq = F.array(*(share(F.coalesce(f"s{j}", F.lit(0)), F.col("frames")) for j in range(width)))
    return one.select("frames", freq.alias("fire_frequency"), F.array(*(f"h{k}" for k in range(width + 1))).alias("weight_histogram"))


def analysis(frames: DataFrame, windows: DataFrame, width: int, observables: int = 1) -> DataFrame:
    """One row: frames, shots, frequencies, weight histogram, logical error rates and whether any truth was known.

    ``windows`` are decoded, with ground_truth.  Frames and windows are each read once, into one row.
    """
    n = min(observables, 64)
    wrong = F.col("observable_flips").bitwiseXOR(F.coalesce("ground_truth", F.lit(0).cast("bigint")))
    sums = [F.coalesce(F.sum(F.getbit(wrong, F.lit(i)).cast("bigint")), F.lit(0).cast("bigint")).alias(f"e{i}") for i in range(n)]
    own = windows.agg(F.count("*").alias("shots"), F.coalesce(F.bool_or(F.col("ground_truth").isNotNull()), F.lit(False)).alias("has_truth"), *sums)
    errors = F.array(*(F.col(f"e{i}") for i in range(n)))
    rates = F.transform(errors, lambda e: share(e, F.col("shots")))
    mean = F.aggregate(rates, F.lit(0.0), lambda a, x: a + x) / max(n, 1)
    own = own.select(rates.alias("p_l"), mean.alias("mean_p_l"), "shots", F.aggregate(errors, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("logical_errors"), "has_truth")
    out = _cell_counts(frames, width).join(F.broadcast(own))
    return out.select("frames", "p_l", "mean_p_l", "shots", "logical_errors", "fire_frequency", "weight_histogram", "has_truth")


def summary(report: DataFrame) -> DataFrame:
    """The report as a line of text."""
    text = F.format_string("frames=%d shots=%d errors=%d mean p_L=%.4e", "frames", "shots", "logical_errors", "mean_p_l")
    return report.select(text.alias("summary"))


def to_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))


def compare_decoders(decoded: DataFrame) -> DataFrame:
    """decoder, shots, error share, median and 99th percentile of the latency."""
    rank = lambda p: F.percentile("latency_ns", F.lit(p))
    wrong = (F.col("observable_flips") != F.coalesce("ground_truth", F.lit(0))).cast("int")
    return decoded.groupBy("decoder").agg(F.count("*").alias("shots"), F.avg(wrong).alias("p_l"), rank(0.5).alias("p50"), rank(0.99).alias("p99"))


def rolling_mean(rows: DataFrame, column: str, last: int = 1000, stream: str = "stream_id", order: str = "frame_id") -> DataFrame:
    over = Window.partitionBy(stream).orderBy(order).rowsBetween(1 - last, 0)
    return rows.withColumn(f"{column}_mean", F.avg(column).over(over))


def last_n(rows: DataFrame, n: int, stream: str = "stream_id", order: str = "frame_id") -> DataFrame:
    """The newest n rows of each stream."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(stream).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def epochs(frames: DataFrame) -> DataFrame:
    """Adds ``epoch``: counts anew whenever a stream's width changes."""
    order = Window.partitionBy("stream_id").orderBy("frame_id")
    change = (F.col("ancilla_count") != F.lag("ancilla_count").over(order)).cast("int")
    return frames.withColumn("_c", F.coalesce(change, F.lit(0))).withColumn("epoch", F.sum("_c").over(order)).drop("_c")


def flip_share(frames: DataFrame) -> DataFrame:
    """Share of frames with any flip, among frames whose flips are known."""
    return frames.where("observable_flips is not null").groupBy("stream_id").agg(F.avg((F.col("observable_flips") != 0).cast("double")).alias("p_l"), F.count("*").alias("frames"))


def gaps(frames: DataFrame) -> DataFrame:
    """Frames missing before each frame of a stream: overrun and dropped frames."""
    missed = F.col("frame_id") - F.lag("frame_id").over(Window.partitionBy("stream_id").orderBy("frame_id")) - 1
    return frames.select("stream_id", "frame_id", missed.alias("missed")).where("missed > 0")


def frames_behind(elapsed_s: float, period_s: float, frames: int) -> int:
    return int(elapsed_s / period_s) - frames


def run_summary(frames: DataFrame, buckets: Column | None = None) -> DataFrame:
    """Frames, time span, rate and the share of each cluster size."""
    from ..functions.codes import cluster_bucket

    b = cluster_bucket(weight(F.col("events"))) if buckets is None else buckets
    parts = [F.avg((b == k).cast("double")).alias(f"cluster_{k}") for k in (1, 2, 3, 4)]
    span = (F.max("timestamp_ns") - F.min("timestamp_ns")) / 1e9
    return frames.agg(F.count("*").alias("frames"), span.alias("seconds"), F.try_divide(F.count("*").cast("double"), span).alias("frames_per_second"), *parts)
