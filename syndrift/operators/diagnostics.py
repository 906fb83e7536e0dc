"""Hardware diagnostics: outliers, drift, correlation and autocorrelation of fire rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outliers(frequency: DataFrame, sigma: float = 3.0, floor: float = 0.0) -> DataFrame:
    """Adds z (population deviation over all ancillas, at least ``floor``) and outlier."""
    one = frequency.agg(F.avg("frequency").alias("_m"), F.greatest(F.stddev_pop("frequency"), F.lit(floor)).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col("frequency") - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return frequency.join(F.broadcast(one)).withColumn("z", z).withColumn("outlier", F.abs("z") > sigma).drop("_m", "_s")


def drift(frames: DataFrame, blocks: int = 20, least: int = 50) -> DataFrame:
    """ancilla and drift: the largest less the smallest mean over blocks of max(least, n div blocks) frames of a stream."""
    stream = Window.partitionBy("stream_id")
    n, k = F.count("*").over(stream), F.row_number().over(stream.orderBy("frame_id")) - 1
    rows = frames.withColumn("block", F.floor(k / F.greatest(F.lit(least), F.floor(n / blocks))))
    cells = rows.select("stream_id", "block", F.posexplode("events").alias("ancilla", "e"))
    means = cells.groupBy("stream_id", "ancilla", "block").agg(F.avg(F.col("e").cast("double")).alias("rate"))
    return means.groupBy("stream_id", "ancilla").agg((F.max("rate") - F.min("rate")).alias("drift"))


def top_drift(drifts: DataFrame, k: int = 5) -> DataFrame:
    return drifts.orderBy(F.desc("drift"), "stream_id", "ancilla").limit(k)


def correlation(frames: DataFrame, least: float = 0.3) -> DataFrame:
    """i, j, r of all pairs of ancillas with a Pearson correlation of more than ``least`` in size.

    One pass: events are 0 or 1, so counts of single and joint fires give r; a frame yields only the pairs among its
    fired ancillas.  What is broadcast has one row for each ancilla, whose number the format keeps below 65,536.
    """
    total = frames.agg(F.count("*").cast("double").alias("n"))
    fired = frames.select(F.filter(F.transform("events", lambda e, i: F.when(e, i)), lambda i: i.isNotNull()).alias("a"))
    single = fired.select(F.explode("a").alias("i")).groupBy("i").agg(F.count("*").cast("double").alias("c"))
    pair = fired.select(F.explode(F.flatten(F.transform("a", lambda x: F.transform(F.filter("a", lambda y: y > x), lambda y: F.struct(x.alias("i"), y.alias("j")))))).alias("p"))
    joint = pair.groupBy("p").agg(F.count("*").cast("double").alias("both")).select("p.i", "p.j", "both")
    # pairs that never fire together correlate too; the ancillas are few, all their pairs are the result's own size
    a, b = single.select("i", F.col("c").alias("ci")), single.select(F.col("i").alias("j"), F.col("c").alias("cj"))
    every = a.join(F.broadcast(b), F.col("i") < F.col("j")).join(joint, ["i", "j"], "left").fillna(0.0, ["both"]).join(F.broadcast(total))
    r = (F.col("n") * F.col("both") - F.col("ci") * F.col("cj")) / F.sqrt(F.col("ci") * (F.col("n") - F.col("ci")) * F.col("cj") * (F.col("n") - F.col("cj")))
    return every.where("ci < n and cj < n").select("i", "j", r.alias("r")).where(F.abs("r") > least)


def autocorrelation(frames: DataFrame, lags: int = 20) -> DataFrame:
    """stream_id, lag, r, limit: of the mean fire rate, over that at lag 0, and the bound 2 / sqrt(n)."""
    rate = F.size(F.filter("events", lambda e: e)) / F.size("events")
    stream = Window.partitionBy("stream_id")
    rows = frames.select("stream_id", "frame_id", rate.alias("x"))
    held = rows.withColumns({"n": F.count("*").over(stream), "x": F.col("x") - F.avg("x").over(stream)})
    order = stream.orderBy("frame_id")
    products = [(F.col("x") * F.lead("x", k).over(order)).alias(f"p{k}") for k in range(lags + 1)]
    sums = held.select("stream_id", "n", *products).groupBy("stream_id", "n").agg(*(F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"p{k}") for k in range(lags + 1)))
    flat = sums.select("stream_id", "n", "p0", F.posexplode(F.array(*(F.col(f"p{k}") for k in range(lags + 1)))).alias("lag", "p"))
    return flat.select("stream_id", "lag", F.when(F.col("p0") != 0, F.col("p") / F.col("p0")).otherwise(F.lit(0.0)).alias("r"), (2 / F.sqrt("n")).alias("limit"))


def intervals(frames: DataFrame) -> DataFrame:
    """Median and 99th percentile (interpolated) of the time between frames of a stream."""
    d = F.col("timestamp_ns") - F.lag("timestamp_ns").over(Window.partitionBy("stream_id").orderBy("frame_id"))
    rows = frames.select("stream_id", d.alias("d")).where("d is not null")
    return rows.groupBy("stream_id").agg(F.percentile("d", F.lit(0.5)).alias("p50"), F.percentile("d", F.lit(0.99)).alias("p99"))


def diagnosis(frequency: DataFrame, p: float, drifts: DataFrame | None = None, high: float = 2.0, low: float = 0.5, most_drift: float = 0.05) -> DataFrame:
    """ancilla, deviation from the expected 2p in percent, and state: overactive, underactive, drifting or ok."""
    rows = frequency.withColumn("deviation", (F.col("frequency") - 2 * p) / (2 * p) * 100)
    moving = F.lit(False)
    if drifts is not None:
        rows = rows.join(drifts.groupBy("ancilla").agg(F.max("drift").alias("drift")), "ancilla", "left")
        moving = F.coalesce(F.col("drift") > most_drift, F.lit(False))
    state = F.when(F.col("frequency") > high * 2 * p, "overactive").when(F.col("frequency") < low * 2 * p, "underactive").when(moving, "drifting").otherwise("ok")
    return rows.withColumn("state", state)
