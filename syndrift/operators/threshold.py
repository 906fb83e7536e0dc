"""Threshold estimates from sweep points (distance, p_physical, p_l, p_l_err, shots, logical_errors)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.dem import ErrorModel
from .decode import decoded
from .graph import Graph
from .metrics import binomial_error, share
from .sample import sample_fast

POINT = "distance int, p_physical double, p_l double, p_l_err double, shots bigint, logical_errors bigint"


def sweep(spark: SparkSession, models: list[ErrorModel], distances: list[int], rates: list[float] | None = None, decoder: str = "union-find", shots: int = 100_000, observables: int = 1, seed: int = 42) -> DataFrame:
    """One point for each model: shots drawn and decoded, errors counted.  Without rates the mean error probability stands in."""
    if len(models) != len(distances) or rates and len(rates) != len(models):
        raise ValueError("as many distances, and rates if any, as models are needed")
    parts = []
    for k, (m, d) in enumerate(zip(models, distances, strict=True)):
        p = rates[k] if rates else m.mean_probability
        drawn = sample_fast(spark, m, shots, seed + k).withColumnRenamed("observable_flips", "truth")
        said = decoded(drawn, decoder, Graph.of(m))
        wrong = F.col("observable_flips").bitwiseXOR(F.col("truth"))
        errors = F.array(*(F.sum(F.getbit(wrong, F.lit(i)).cast("bigint")) for i in range(observables)))
        point = said.agg(F.count("*").alias("shots"), errors.alias("e"))
        p_l = F.aggregate(F.transform("e", lambda x: share(x, F.col("shots"))), F.lit(0.0), lambda a, x: a + x) / observables
        total = F.aggregate("e", F.lit(0).cast("bigint"), lambda a, x: a + x)
        rows = point.select(F.lit(d).alias("distance"), F.lit(float(p)).alias("p_physical"), p_l.alias("p_l"), "shots", total.alias("logical_errors"))
        parts.append(rows.withColumn("p_l_err", binomial_error(F.col("p_l"), F.col("shots"))))
    return reduce(DataFrame.unionByName, parts)


def union(points: list[DataFrame], labels: list[str]) -> DataFrame:
    """All files' points with the label of their file; no points at all is an error."""
    out = reduce(DataFrame.unionByName, [p.withColumn("label", F.lit(n)) for p, n in zip(points, labels, strict=True)])
    if out.isEmpty():
        raise ValueError("no points")
    return out


def at_rate(points: DataFrame, at: DataFrame) -> DataFrame:
    """Adds ``p_l_at``: p_l of a distance at other rates (distance, p), linear between points and constant outside."""
    order = Window.partitionBy("distance").orderBy("p_physical")
    pieces = points.select("distance", F.col("p_physical").alias("p0"), F.col("p_l").alias("y0"), F.lead("p_physical").over(order).alias("p1"), F.lead("p_l").over(order).alias("y1"), F.row_number().over(order).alias("k"))
    joined = at.join(F.broadcast(pieces), "distance", "left")
    first, last = (F.col("k") == 1) & (F.col("p") < F.col("p0")), F.col("p1").isNull() & (F.col("p") >= F.col("p0"))
    inside = (F.col("p") >= F.col("p0")) & (F.col("p") < F.col("p1"))
    y = F.when(first, F.col("y0")).when(last, F.col("y0")).when(inside, F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("p") - F.col("p0")) / (F.col("p1") - F.col("p0")))
    return joined.groupBy(*at.columns).agg(F.max(y).alias("p_l_at"))


def distance_pairs(points: DataFrame) -> DataFrame:
    """d_lo and d_hi of neighbouring distances; there are few distances."""
    d = points.select("distance").distinct()
    return d.select(F.col("distance").alias("d_lo"), F.lead("distance").over(Window.orderBy("distance")).alias("d_hi")).where("d_hi is not null")


def crossings(points: DataFrame) -> DataFrame:
    """d_lo, d_hi, p_cross: zeros, by linear interpolation, of the difference between neighbouring distances."""
    low = distance_pairs(points).join(points.select(F.col("distance").alias("d_lo"), F.col("p_physical").alias("p"), "p_l"), "d_lo")
    other = at_rate(points, low.select(F.col("d_hi").alias("distance"), "p").distinct()).withColumnRenamed("distance", "d_hi")
    rows = low.join(other, ["d_hi", "p"]).withColumn("diff", F.col("p_l_at") - F.col("p_l"))
    order = Window.partitionBy("d_lo", "d_hi").orderBy("p")
    steps = rows.select("d_lo", "d_hi", "p", "diff", F.lead("p").over(order).alias("p1"), F.lead("diff").over(order).alias("diff1"))
    cross = F.col("p") + (F.col("p1") - F.col("p")) * F.col("diff") / (F.col("diff") - F.col("diff1"))
    return steps.where("diff * diff1 < 0").select("d_lo", "d_hi", cross.alias("p_cross"))


def estimate(points: DataFrame) -> DataFrame:
    """For every pair of distances the mean of all crossings so far, pairs in order; and, last, of all if there are several."""
    found = crossings(points).groupBy("d_lo", "d_hi").agg(F.sum("p_cross").alias("s"), F.count("*").alias("n"))
    order = Window.orderBy("d_lo").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.select("d_lo", "d_hi", (F.sum("s").over(order) / F.sum("n").over(order)).alias("threshold"))
    whole = found.agg(F.lit(None).cast("int").alias("d_lo"), F.lit(None).cast("int").alias("d_hi"), (F.sum("s") / F.sum("n")).alias("threshold"), F.sum("n").alias("n")).where("n > 1").drop("n")
    return rows.unionByName(whole)


def common_rates(points: DataFrame, d_lo: int, d_hi: int) -> DataFrame:
    """Rates at which both distances have points, with both rates of logical errors."""
    a, b = points.where(F.col("distance") == d_lo), points.where(F.col("distance") == d_hi)
    shared = a.select("p_physical").intersect(b.select("p_physical"))
    lo, hi = a.select("p_physical", F.col("p_l").alias("p_l_lo")), b.select("p_physical", F.col("p_l").alias("p_l_hi"))
    return shared.join(lo, "p_physical").join(hi, "p_physical")


def suppression(points: DataFrame) -> DataFrame:
    """p_physical and the factor exp(slope of ln p_l by distance)."""
    return points.where("p_l > 0").groupBy("p_physical").agg(F.exp(F.regr_slope(F.ln("p_l"), F.col("distance").cast("double"))).alias("factor"))


def nearest_rate(points: DataFrame, p_ref: float) -> DataFrame:
    """The points of the rate nearest to ``p_ref``."""
    best = points.agg(F.min_by("p_physical", F.struct(F.abs(F.col("p_physical") - p_ref), F.col("p_physical"))).alias("best"))
    return points.join(F.broadcast(best)).where("p_physical = best").drop("best")


def _text(c: str) -> Column:
    return F.format_string("%.10e", F.col(c))


def write_csv(points: DataFrame, path: str) -> None:
    """With a header and ten decimals; a sweep has few points, so it is one file."""
    cols = ["distance", *(_text(c).alias(c) for c in ("p_physical", "p_l", "p_l_err")), "shots", "logical_errors"]
    points.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINT).option("header", True).option("mode", "FAILFAST").csv(path)


def write_json(points: DataFrame, path: str) -> None:
    points.agg(F.collect_list(F.struct(*points.columns)).alias("points")).coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A run's output with ``points``, or a bare list."""
    text = spark.read.text(path, wholetext=True)
    run = F.from_json("value", f"points array<struct<{POINT.replace(' ', ':').replace(',:', ',')}>>")
    bare = F.from_json("value", f"array<struct<{POINT.replace(' ', ':').replace(',:', ',')}>>")
    held = F.when(F.ltrim("value").startswith("["), bare).otherwise(run["points"])
    return text.select(F.explode(held).alias("p")).select("p.*")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path) if path.rstrip("/").endswith(".json") else read_csv(spark, path)


def svg(points: DataFrame, width: int = 640, height: int = 420) -> str:
    """A log-log plot with a line for each distance; the points of a sweep are few."""
    import math

    rows = points.where("p_l > 0 and p_physical > 0").orderBy("distance", "p_physical").collect()
    lx, ly = [math.log10(r.p_physical) for r in rows] or [0], [math.log10(r.p_l) for r in rows] or [0]
    scale = lambda v, lo, hi, a, b: a + (v - lo) / ((hi - lo) or 1) * (b - a)
    lines: dict[int, list[str]] = {}
    for r, x, y in zip(rows, lx, ly, strict=False):
        lines.setdefault(r.distance, []).append(f"{scale(x, min(lx), max(lx), 60, width - 20):.1f},{scale(y, min(ly), max(ly), height - 40, 20):.1f}")
    body = "".join(f'<polyline fill="none" stroke="hsl({k * 67 % 360},70%,40%)" points="{" ".join(pts)}"><title>d={d}</title></polyline>' for k, (d, pts) in enumerate(lines.items()))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{body}<text x="60" y="{height - 10}">physical error rate</text></svg>\n'


def write_svg(points: DataFrame, path: str, width: int = 640, height: int = 420) -> None:
    with open(path, "w") as out:
        out.write(svg(points, width, height))
