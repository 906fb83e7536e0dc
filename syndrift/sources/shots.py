"""Text, JSON and array sources of shots, the SSDS dataset, and adapters for vendors' results."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits


def _numbered(lines: DataFrame) -> DataFrame:
    """Text lines with a dense number in file order; ranges of the input are numbered apart, then shifted."""
    held = lines.withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_place", 33))
    own = Window.partitionBy("_part").orderBy("_place")
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return held.withColumn("n", F.row_number().over(own) - 1).join(F.broadcast(ahead), "_part").withColumn("n", F.col("n") + F.col("_ahead")).drop("_place", "_part", "_n", "_ahead")


def bits_of(line: Column) -> Column:
    """A boolean for each character: 1 is fired, any other is not."""
    return F.transform(F.filter(F.split(line, ""), lambda c: c != ""), lambda c: c == "1")


def read_01(spark: SparkSession, path: str) -> DataFrame:
    """One shot for each line that is not blank: frame_id (its number), round, timestamp_ns, events, meas.

    The first line's length is the ancilla count; longer lines are cut, shorter ones padded.
    """
    lines = _numbered(spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("value")))
    width = lines.where("n = 0").select(F.length("value").alias("ancilla_count"))
    rows = lines.join(F.broadcast(width)).withColumn("events", bits.fit(bits_of(F.col("value")), F.col("ancilla_count")))
    return rows.select(F.col("n").alias("frame_id"), F.col("n").alias("round"), F.lit(0).cast("bigint").alias("timestamp_ns"), "ancilla_count", "events", bits.outcomes(F.col("events")).alias("meas"))


def read_observables(spark: SparkSession, path: str) -> DataFrame:
    """frame_id and observable_flips of each line; the first 64 characters count, the i-th is bit i."""
    lines = _numbered(spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("value")))
    return lines.select(F.col("n").alias("frame_id"), bits.pack_mask(bits_of(F.col("value"))).alias("observable_flips"))


def with_observables(shots: DataFrame, observables: DataFrame) -> DataFrame:
    """Shots with the observables of the same line; those past the end of the observables have none."""
    return shots.join(observables, "frame_id", "left")


def read_json(spark: SparkSession, path: str, register: str = "meas", observable_register: str | None = None, strict: bool = True) -> DataFrame:
    """Shots of a plain JSON document {register: [[0, 1, ..], ..]}.

    A missing register is an error; a missing observable register is one only if ``strict``.
    """
    text = spark.read.text(path, wholetext=True)
    doc = text.select(F.from_json("value", "map<string,array<array<int>>>").alias("d"))
    keys = {k for r in doc.select(F.map_keys("d").alias("k")).collect() for k in r.k or []}
    if register not in keys:
        raise KeyError(register)
    if observable_register and observable_register not in keys:
        if strict:
            raise KeyError(observable_register)
        observable_register = None
    rows = doc.select(F.posexplode(F.col("d")[register]).alias("frame_id", "bits"), (F.col("d")[observable_register] if observable_register else F.lit(None).cast("array<array<int>>")).alias("o"))
    events = F.transform("bits", lambda b: b != 0)
    flips = F.when(F.col("o").isNotNull(), bits.pack_mask(F.transform(F.get("o", F.col("frame_id")), lambda b: b != 0)))
    return rows.select(F.col("frame_id").cast("bigint").alias("frame_id"), F.lit(0).cast("bigint").alias("round"), F.size("bits").alias("ancilla_count"), events.alias("events"), flips.alias("observable_flips"))


def from_arrays(spark: SparkSession, shots, observables=None, round_: int = 0) -> DataFrame:
    """Shots of a two-dimensional array of 0 and 1 (one dimension is one shot), as simulators return them."""
    x = np.atleast_2d(np.asarray(shots)).astype(bool)
    y = None if observables is None else np.atleast_2d(np.asarray(observables)).astype(bool)
    masks = [None if y is None or i >= len(y) else _mask(y[i]) for i in range(len(x))]
    rows = [(i, round_, len(r), r.tolist(), m) for i, (r, m) in enumerate(zip(x, masks, strict=True))]
    return spark.createDataFrame(rows, "frame_id bigint, round int, ancilla_count int, events array<boolean>, observable_flips bigint")


def _mask(row: np.ndarray) -> int:
    m = sum(int(b) << j for j, b in enumerate(row[:64]))
    return m - (1 << 64) if m >= 1 << 63 else m


def bits_from_strings(strings: list[str]) -> list[list[int]]:
    """Bit strings in the order of their characters."""
    return [[int(c == "1") for c in s] for s in strings]


def bits_from_bytes(rows, num_bits: int) -> np.ndarray:
    """Packed bytes, most significant bit first; the first ``num_bits`` count."""
    return np.unpackbits(np.asarray(rows, np.uint8), axis=-1)[..., :num_bits]


def from_pubs(spark: SparkSession, pubs: list[dict], register: str = "meas", observable_register: str | None = None) -> DataFrame:
    """Results of several circuits, {register: shots} each; frame ids start anew in every one (``pub``)."""
    out = None
    for k, pub in enumerate(pubs):
        part = from_arrays(spark, pub[register], pub[observable_register] if observable_register else None).withColumn("pub", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def from_simulator(spark: SparkSession, measurements: dict, key: str, observable_key: str | None = None, round_: int = 0) -> DataFrame:
    """Measurements of a simulator by key; a missing observable key is ignored."""
    return from_arrays(spark, measurements[key], measurements.get(observable_key) if observable_key else None, round_)


def read_measurement_file(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


SSDS = struct.Struct("<4sBQII")


def encode_ssds(x: np.ndarray, y: np.ndarray, observables: int) -> bytes:
    """The dataset format: header, detector bytes row by row, then a 64-bit mask for each shot."""
    return SSDS.pack(b"SSDS", 1, len(x), x.shape[1], observables) + x.astype(np.uint8).tobytes() + y.astype("<u8").tobytes()


def decode_ssds(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    magic, version, shots, detectors, observables = SSDS.unpack_from(data)
    if magic != b"SSDS" or version != 1:
        raise ValueError("not a dataset of version 1")
    x = np.frombuffer(data, np.uint8, shots * detectors, SSDS.size).reshape(shots, detectors)
    return x, np.frombuffer(data, "<u8", shots, SSDS.size + shots * detectors), observables


def ssds_blocks(drawn: DataFrame, detectors: int, observables: int, size: int = 10_000) -> DataFrame:
    """block and content: a dataset for every ``size`` shots of (shot, active, observable_flips), in the order of shots.

    A shot that is missing inside a block is left out, so numbers stay right only without gaps.
    """

    def run(rows):
        import pandas as pd

        rows = rows.sort_values("shot")
        x = np.zeros((len(rows), detectors), np.uint8)
        x[np.repeat(np.arange(len(rows)), rows["active"].map(len)), np.concatenate([np.zeros(0, int), *rows["active"]]).astype(int)] = 1
        data = encode_ssds(x, rows["observable_flips"].to_numpy(np.int64).view(np.uint64), observables)
        return pd.DataFrame({"block": rows["_block"].iloc[:1], "content": [data]})

    own = drawn.select("shot", "active", "observable_flips", F.floor(F.col("shot") / size).alias("_block"))
    return own.groupBy("_block").applyInPandas(run, "block bigint, content binary")


def read_ssds(spark: SparkSession, path: str) -> DataFrame:
    """shot, events, observable_flips of every dataset file below ``path``."""
    return parse_ssds(spark.read.format("binaryFile").load(path)).drop("block")


def parse_ssds(files: DataFrame) -> DataFrame:
    """block (null without such a column), shot (its number in the block), events, observable_flips of datasets in ``content``."""
    block = F.col("block").cast("bigint") if "block" in files.columns else F.lit(None).cast("bigint")

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        for part in parts:
            for block, data in zip(part["block"], part["content"], strict=True):
                x, y, _ = decode_ssds(data)
                for at in range(0, len(x), 4096):
                    own = slice(at, at + 4096)
                    yield pd.DataFrame({"block": block, "shot": np.arange(len(x))[own], "events": list(x[own].astype(bool)), "observable_flips": y[own].astype(np.int64)})

    return files.select(block.alias("block"), "content").mapInPandas(run, "block bigint, shot bigint, events array<boolean>, observable_flips bigint")
