"""Validation of frames: timing, schema and parity; errors go to a column, so bad frames can be set aside.

Schemas are one row for each code and are broadcast while there are at most ``BROADCAST_SCHEMAS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import code_number

MAX_OFFSET_NS = 10_000
BROADCAST_SCHEMAS = 100_000

#: The kinds of errors.
ERRORS = [
    "InvalidMagic", "UnsupportedVersion", "UnknownCodeType", "SchemaNotFound", "ChecksumMismatch", "ParityViolation", "TimingOutOfBounds",
    "PayloadLengthMismatch", "FrameOutOfOrder", "SchemaFrameMismatch", "BroadcastLagged", "Io", "SchemaJson",
]


def late_ancilla(timing: Column, limit: int = MAX_OFFSET_NS) -> Column:
    """The first ancilla whose offset is over the limit; null if none."""
    at = F.array_position(F.transform(timing, lambda x: x > limit), True)
    return F.when(at > 0, (at - 1).cast("int"))


def with_schema(frames: DataFrame, schemas: DataFrame) -> DataFrame:
    """Frames with the schema of their file, null if it is not registered."""
    own = schemas.select("schema_id", F.struct("code_type", "distance", "qubit_count", "ancilla_count", "stabilizers").alias("schema"))
    return frames.join(F.broadcast(own) if own.count() <= BROADCAST_SCHEMAS else own, "schema_id", "left")


def mismatch(ancillas: Column, qubits: Column, code_type: Column, schema: Column) -> Column:
    """The first field that disagrees with the schema; a code name that is not known is not compared."""
    known = code_number(schema["code_type"])
    return F.when(ancillas != schema["ancilla_count"], "ancilla_count").when(qubits != schema["qubit_count"], "qubit_count").when(known.isNotNull() & (code_type != known), "code_type")


def violated(events: Column, meas: Column, stabilizers: Column) -> Column:
    """Position of the first stabilizer whose outcomes' parity is not its event; qubits without outcome do not count."""

    def wrong(s: Column, i: Column) -> Column:
        odd = F.aggregate(s["qubits"], F.lit(0), lambda a, q: (a + F.coalesce((F.get(meas, q) <= 0).cast("int"), F.lit(0))) % 2)
        return odd != F.coalesce(F.get(events, i), F.lit(False)).cast("int")

    at = F.array_position(F.transform(stabilizers, wrong), True)
    return F.when(at > 0, (at - 1).cast("int"))


def validate(frames: DataFrame, schemas: DataFrame | None = None, policy: str = "strict") -> DataFrame:
    """Adds ``error`` (kind, detail), null for good frames.  Policies: strict, or crc and none, which add no check to the reader's."""
    if policy != "strict":
        return frames.withColumn("error", F.lit(None).cast("struct<kind:string,detail:string>"))
    say = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
    late = late_ancilla(F.col("timing_ns")) if "timing_ns" in frames.columns else F.lit(None).cast("int")
    checks = [F.when(late.isNotNull(), say("TimingOutOfBounds", late))]
    if schemas is not None:
        frames = with_schema(frames, schemas)
        other = mismatch(F.col("ancilla_count"), F.col("qubit_count"), F.col("code_type"), F.col("schema"))
        parity = violated(F.col("events"), F.col("meas"), F.col("schema.stabilizers"))
        checks += [F.when(other.isNotNull(), say("SchemaFrameMismatch", other)), F.when(parity.isNotNull(), say("ParityViolation", parity))]
    return frames.withColumn("error", F.coalesce(*checks)).drop("schema")


def out_of_order(frames: DataFrame, stream: str = "stream_id", arrival: str = "arrival") -> DataFrame:
    """Adds ``last_id`` and ``in_order``: whether a frame's id exceeds every one that arrived before."""
    before = Window.partitionBy(stream).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("last_id", F.max("frame_id").over(before)).withColumn("in_order", F.coalesce(F.col("frame_id") > F.col("last_id"), F.lit(True)))


def same_width(frames: DataFrame) -> DataFrame:
    """Only frames of the width of their stream's first frame."""
    first = frames.groupBy("stream_id").agg(F.min_by("ancilla_count", "frame_id").alias("_width"))
    return frames.join(first, "stream_id").where("ancilla_count = _width").drop("_width")
