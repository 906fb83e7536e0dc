"""Spacetime graphs of detector error models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import edge_weight
from ..sources.dem import ErrorModel


def edges(errors: DataFrame, boundary: int) -> DataFrame:
    """seq, u, v, weight, fault_mask of the graph of dem_errors(seq, p, detectors, observables).

    An error of one detector is an edge to the boundary; one of several is a chain of edges, each with the whole
    weight and all observables; those of none, and sure or impossible ones, have no edge.  ``seq`` keeps the
    model's order, which decoders depend on.
    """
    mask = F.aggregate("observables", F.lit(0).cast("bigint"), lambda a, o: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), o.cast("int"))))
    ends = F.when(F.size("detectors") == 1, F.array(F.get("detectors", F.lit(0)), F.lit(boundary).cast("bigint"))).otherwise(F.col("detectors"))
    real = errors.where("p > 0 and p < 1 and size(detectors) > 0").select("seq", "p", ends.alias("ends"), mask.alias("fault_mask"))
    pairs = F.arrays_zip(F.slice("ends", F.lit(1), F.size("ends") - 1).alias("u"), F.slice("ends", F.lit(2), F.size("ends") - 1).alias("v"))
    rows = real.select("seq", "p", "fault_mask", F.posexplode(pairs).alias("link", "e"))
    return rows.select("seq", "link", F.col("e.u").alias("u"), F.col("e.v").alias("v"), edge_weight(F.col("p")).alias("weight"), "fault_mask")


@dataclass
class Graph:
    """A graph as decoders take it: edge ends, weights and fault masks in model order; the boundary is the last node."""

    detectors: int
    u: np.ndarray
    v: np.ndarray
    weight: np.ndarray
    mask: np.ndarray

    @property
    def nodes(self) -> int:
        return self.detectors + 1

    @classmethod
    def of(cls, model: ErrorModel) -> Graph:
        n, rows = model.detector_count, []
        for p, ds, os in model.errors:
            if not 0 < p < 1 or not ds:
                continue
            mask = 0
            for o in os:
                mask |= 1 << (o & 63)
            ends = [*ds, n] if len(ds) == 1 else ds
            weight = float(np.float32(-np.log(p / (1 - p))))
            rows += [(a, b, weight, mask) for a, b in zip(ends, ends[1:])]
        cols = list(zip(*rows)) or [(), (), (), ()]
        return cls(n, np.array(cols[0], np.int64), np.array(cols[1], np.int64), np.array(cols[2], float), np.array(cols[3], np.uint64))

    @classmethod
    def collect(cls, edges: DataFrame, detectors: int) -> Graph:
        """From the rows of ``edges``; a model's graph is as large as its text, whatever the shots."""
        rows = edges.orderBy("seq", "link").collect()
        return cls(detectors, np.array([r.u for r in rows], np.int64), np.array([r.v for r in rows], np.int64), np.array([r.weight for r in rows], float), np.array([r.fault_mask & 0xFFFFFFFFFFFFFFFF for r in rows], np.uint64))
