"""Sampling shots from error models, by a hash of seed, shot and error: reproducible however the work is split.

The uniform number of (seed, shot, error) is the first 52 bits of an MD5 digest, so SQL engines can repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.dem import ErrorModel

MAX_THRESHOLD = (1 << 64) - 1


def threshold(p: float) -> int:
    """The largest of 64 random bits at which an error of probability p fires."""
    return MAX_THRESHOLD if p >= 1 else 0 if p <= 0 else min(int(p * 2.0**64), MAX_THRESHOLD)


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) fixed by the keys."""
    digest = F.md5(F.concat_ws(":", *(k.cast("string") for k in keys)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def fires(p: Column, *keys: Column) -> Column:
    return F.when(p >= 1, True).when(p <= 0, False).otherwise(uniform(*keys) < p)


def sample(spark: SparkSession, errors: DataFrame, shots: int, seed: int = 42) -> DataFrame:
    """shot, active (fired detectors, ascending) and observable_flips, in relational form.

    Every shot meets every error of the model, which is as large as its text; only errors that fire go on.
    """
    rows = spark.range(shots).withColumnRenamed("id", "shot")
    model = errors.select(F.collect_list(F.struct("seq", "p", "detectors", "observables")).alias("model"))
    met = rows.join(F.broadcast(model)).select("shot", F.filter("model", lambda e: fires(e["p"], F.lit(seed), F.col("shot"), e["seq"])).alias("fired"))
    hits = F.flatten(F.transform("fired", lambda e: e["detectors"]))
    odd = F.filter(F.array_sort(F.array_distinct(hits)), lambda d: F.size(F.filter(hits, lambda x: x == d)) % 2 == 1)
    one = lambda e: F.aggregate(e["observables"], F.lit(0).cast("bigint"), lambda a, o: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), o.cast("int"))))
    flips = F.aggregate("fired", F.lit(0).cast("bigint"), lambda a, e: a.bitwiseXOR(one(e)))
    return met.select("shot", odd.alias("active"), flips.alias("observable_flips"))


class Sampler:
    """Errors of a model and what they flip, for many shots at once.

    Errors are rare, so what is drawn is not every error in every shot but the gaps between the shots in which an error
    fires: geometric, which is the same as independent draws.
    """

    def __init__(self, model: ErrorModel):
        self.detectors, self.observables = model.detector_count, model.observable_count
        real = [(p, ds, [o & 63 for o in os]) for p, ds, os in model.errors if p > 0]
        self.p = np.array([min(p, 1.0) for p, _, _ in real])
        self.hits = self._rows([ds for _, ds, _ in real])
        self.mask = self._rows([os for _, _, os in real])

    @staticmethod
    def _rows(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Ends and values of lists that lie end to end."""
        return np.cumsum([0, *map(len, lists)]), np.array([x for own in lists for x in own], np.int64)

    def fires(self, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """(shot, error) of everything that fires in n shots."""
        if not len(self.p):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        most = self.p.max()
        width = int(n * most + 6 * (n * most) ** 0.5) + 8
        at, last = [], np.full(len(self.p), -1, np.int64)
        while (last < n).any():
            # a gap may exceed any number; longer ones than n end the row alike
            gaps = np.minimum(rng.geometric(self.p[:, None], (len(self.p), width)), n + 1)
            at.append(last[:, None] + np.cumsum(gaps, axis=1))
            last = at[-1][:, -1]
        shots = np.concatenate(at, axis=1)
        error, k = np.nonzero(shots < n)
        return shots[error, k], error

    @staticmethod
    def _parity(shot: np.ndarray, error: np.ndarray, rows: tuple[np.ndarray, np.ndarray], n: int, width: int) -> np.ndarray:
        """n x width: whether what fires names a place an odd number of times."""
        ends, values = rows
        many = ends[error + 1] - ends[error]
        upto = np.cumsum(many)
        which = values[np.repeat(ends[error] - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)]
        return (np.bincount(np.repeat(shot, many) * width + which, minlength=n * width) & 1).astype(bool).reshape(n, width)

    def draw(self, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """(shots x detectors, 64-bit masks)."""
        shot, error = self.fires(n, rng)
        events = self._parity(shot, error, self.hits, n, max(self.detectors, 1))[:, : self.detectors]
        width = min(max(self.observables, 1), 64)
        flips = self._parity(shot, error, self.mask, n, width).astype(np.uint64)
        return events, (flips << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def sample_fast(spark: SparkSession, model: ErrorModel, shots: int, seed: int = 42, block: int = 4096) -> DataFrame:
    """shot, active, observable_flips; every block of shots has a generator of its own."""
    return sample_with(spark, Sampler(model), shots, seed, block)


def sample_with(spark: SparkSession, sampler, shots: int, seed: int = 42, block: int = 4096) -> DataFrame:
    """The same for any object with ``draw(n, rng) -> (shots x detectors, 64-bit masks)``, such as ``plugins.Circuit``."""
    held = spark.sparkContext.broadcast(sampler)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                n = min(block, shots - b * block)
                events, flips = held.value.draw(n, np.random.default_rng([seed, b]))
                shot, detector = np.nonzero(events)
                ends = np.searchsorted(shot, np.arange(n + 1)).astype(np.int32)
                active = pa.ListArray.from_arrays(pa.array(ends), pa.array(detector.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + b * block), active, pa.array(flips.view(np.int64))], ["shot", "active", "observable_flips"])

    blocks = -(-shots // block)
    return spark.range(0, blocks, 1, max(1, min(blocks, 8 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "shot bigint, active array<int>, observable_flips bigint")


@dataclass(frozen=True)
class Depolarizing:
    """A model whose errors stem from one rate p."""

    model: ErrorModel
    p: float

    def shots(self, spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
        return sample_fast(spark, self.model, n, seed).withColumn("p", F.lit(self.p))


@dataclass(frozen=True)
class BiasedPauli:
    """A model whose errors stem from three rates."""

    model: ErrorModel
    p_x: float
    p_y: float
    p_z: float

    @property
    def total(self) -> float:
        return self.p_x + self.p_y + self.p_z

    def shots(self, spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
        return sample_fast(spark, self.model, n, seed).withColumns({"p_x": F.lit(self.p_x), "p_y": F.lit(self.p_y), "p_z": F.lit(self.p_z)})


def noisy_frames(spark: SparkSession, n: int, p: float, ancillas: int = 24, factors: dict[int, float] | None = None, seed: int = 42) -> DataFrame:
    """Frames whose ancillas fire with probability 2p, times a factor for some of them."""
    rate = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in (factors or {-1: 1.0}).items() for x in kv)), F.col("j")), F.lit(1.0)) * (2 * p)
    cells = spark.range(n).select(F.col("id").alias("frame_id"), F.explode(F.sequence(F.lit(0), F.lit(ancillas - 1))).alias("j"))
    fired = cells.withColumn("e", uniform(F.lit(seed), F.col("frame_id"), F.col("j")) < rate)
    rows = fired.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("j", "e"))).alias("r"))
    return rows.select(F.lit("noisy").alias("stream_id"), "frame_id", F.col("r.e").alias("events"))


def threshold_points(spark: SparkSession, distances: list[int], rates: list[float], p_th: float, shots: int = 100_000) -> DataFrame:
    """Points of the scaling law p_l = 0.5 (p / p_th) ** ((d + 1) / 2), at most one half."""
    d = spark.createDataFrame([(x,) for x in distances], "distance int")
    p = spark.createDataFrame([(x,) for x in rates], "p_physical double")
    p_l = F.least(0.5 * F.pow(F.col("p_physical") / p_th, (F.col("distance") + 1) / 2), F.lit(0.5))
    rows = d.join(F.broadcast(p)).withColumns({"p_l": p_l, "shots": F.lit(shots).cast("bigint")})
    return rows.withColumns({"p_l_err": F.sqrt(F.col("p_l") * (1 - F.col("p_l")) / F.col("shots")), "logical_errors": F.round(F.col("p_l") * F.col("shots")).cast("bigint")})
