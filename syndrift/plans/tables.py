"""The driver's tables as frames, points and models, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import dem

MODULUS, ANCILLAS, DEPTH = 21, 24, 5
#: Three detectors in a row between two boundaries.
REPETITION = "error(0.1) D0 D1 ^ L0\nerror(0.1) D1 D2\nerror(0.1) D2 ^ L0\n"
MIXED = "error(0.1) D0 D1 ^ L0\nerror(0.05) D1 D2\nerror(0.02) D0 D1 D2 L1\nerror(0) D0\nerror(0.3) D2\ndetector(0,1,0) D0\ndetector(1,1,0) D1\ndetector(2,1,0) D2\n"

#: The frames of ``events``: event j fires where (event_id + j) is a multiple of the modulus.
FRAMES_SQL = f"""f AS (SELECT CAST(user_id AS VARCHAR) AS stream_id, event_id AS frame_id, epoch_us(ts) * 1000 AS timestamp_ns,
  [(event_id + j) % {MODULUS} = 0 for j in range({ANCILLAS})] AS events, CAST(event_type = 'error' AS BIGINT) AS ground_truth, CAST((event_id + user_id) % 8 AS INTEGER) AS syndrome FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") * 1000
    fired = F.transform(F.sequence(F.lit(0), F.lit(ANCILLAS - 1)), lambda j: (F.col("event_id") + j) % MODULUS == 0)
    return events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("frame_id"), ns.alias("timestamp_ns"), fired.alias("events"),
        (F.col("event_type") == "error").cast("bigint").alias("ground_truth"), ((F.col("event_id") + F.col("user_id")) % 8).cast("int").alias("syndrome"), F.lit(ANCILLAS).alias("ancilla_count"),
    )


def syndromes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-round windows of the three-detector model: the bits of ``syndrome``."""
    bits = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.getbit(F.col("syndrome"), i) == 1)
    return frames(spark, sf_dir).select("stream_id", "frame_id", "syndrome", "ground_truth", bits.alias("active"))


def model() -> dem.ErrorModel:
    return dem.parse(REPETITION)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep points by return flag and line number: distance 3, 5, 7 and the share of late discounts as a rate."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    d = F.lit(3) + 2 * F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END")
    wrong = F.pmod(F.col("l_orderkey") * (d + 2) + F.col("l_partkey"), F.lit(1000)) < F.lit(9) * F.pow(F.col("l_linenumber"), (d + 1) / 2)
    out = rows.groupBy(d.alias("distance"), (F.col("l_linenumber") / 100).alias("p_physical")).agg(F.count("*").alias("shots"), F.sum(wrong.cast("bigint")).alias("logical_errors"))
    return out.withColumn("p_l", F.col("logical_errors") / F.col("shots")).withColumn("p_l_err", F.sqrt(F.col("p_l") * (1 - F.col("p_l")) / F.col("shots")))


POINTS_SQL = """g AS (SELECT 3 + 2 * CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS distance, l_linenumber, l_orderkey, l_partkey FROM lineitem),
t AS (SELECT distance, l_linenumber / 100.0::DOUBLE AS p_physical, count(*) AS shots, sum(CAST((l_orderkey * (distance + 2) + l_partkey) % 1000 < 9 * pow(l_linenumber, (distance + 1) / 2.0) AS BIGINT)) AS logical_errors FROM g GROUP BY ALL),
pts AS (SELECT distance, p_physical, shots, CAST(logical_errors AS BIGINT) AS logical_errors, CAST(logical_errors AS DOUBLE) / shots AS p_l,
  sqrt((CAST(logical_errors AS DOUBLE) / shots) * (1 - CAST(logical_errors AS DOUBLE) / shots) / shots) AS p_l_err FROM t)"""


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Doubles rounded, for comparison across engines."""
    return df.select(*(F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))
