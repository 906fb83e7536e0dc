"""Hardware schemas: a registry by UUID, the built-in codes, and generators from code parameters or error models."""

from __future__ import annotations

import base64
import struct
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dem import ErrorModel

SCHEMA = (
    "schema_id string, version string, name string, description string, code_type string, distance int, qubit_count int, ancilla_count int, "
    "stabilizers array<struct<id:int,type:string,qubits:array<int>>>, measurement_cycle_us double, ancilla_layout string, "
    "ldpc_hz_matrix string, ldpc_hx_matrix string, logical_z string, logical_x string, encoding_rate double, dem_path string"
)

#: Id, name, description, family, distance, qubits, ancillas, cycle, layout, and the stabilizers listed.
SMALL = [
    ("b1e4d309-3c11-4a09-8b2b-0e1f7c6a4b00", "surface_code_d3", "Distance-3 rotated surface code", "surface", 3, 9, 8, 1.0, "row_major", [("X", [0, 1, 3, 4]), ("Z", [1, 2, 4, 5]), ("X", [3, 4, 6, 7]), ("Z", [4, 5, 7, 8])]),
    ("a3f7c210-4e12-4b0a-9b3c-1f2e8d7a5c01", "surface_code_d5", "Distance-5 rotated surface code", "surface", 5, 25, 24, 1.1, "row_major", [("X", [0, 1, 5, 6]), ("Z", [1, 2, 6, 7]), ("X", [2, 3, 7, 8]), ("Z", [3, 4, 8, 9])]),
    ("c5f8e421-5f13-4c1b-ac4d-2a3f9e8b6d02", "surface_code_d7", "Distance-7 rotated surface code", "surface", 7, 49, 48, 1.2, "row_major", [("X", [0, 1, 7, 8]), ("Z", [1, 2, 8, 9]), ("X", [2, 3, 9, 10]), ("Z", [3, 4, 10, 11]), ("X", [7, 8, 14, 15]), ("Z", [8, 9, 15, 16])]),
    ("d6a9f532-6014-4d2c-bd5e-3b4a0f9c7e03", "honeycomb_d4", "Distance-4 honeycomb code", "honeycomb", 4, 24, 12, 0.9, "honeycomb", [("XZ"[k % 2], [3 * k, 3 * k + 1, 3 * k + 2]) for k in range(6)]),
    ("e7b09643-7015-4e3d-ae6f-4c5b1a0d8f04", "color_code_d5", "Distance-5 color code on a triangular lattice", "color", 5, 21, 20, 1.3, "triangular", [(t, q) for q in ([0, 1, 3, 4], [1, 2, 4, 5], [3, 4, 7, 8]) for t in "XZ"]),
    ("f8c10754-8016-4f4e-9f7b-5c6a2b1e9004", "repetition_d11", "Distance-11 repetition code", "repetition", 11, 11, 10, 0.5, "linear", [("Z", [k, k + 1]) for k in range(6)]),
]


@dataclass(frozen=True)
class Bicycle:
    """A bivariate bicycle code: the torus l x m, and the offsets of its two polynomials."""

    l: int  # noqa: E741
    m: int
    a: tuple[tuple[int, int], ...]
    b: tuple[tuple[int, int], ...]
    distance: int
    logical_qubits: int

    @property
    def n(self) -> int:
        return 2 * self.l * self.m

    @property
    def encoding_rate(self) -> float:
        return self.logical_qubits / self.n


#: Two published codes, with x**3 + y + y**2 and y**3 + x + x**2.
PRESETS = {
    "bb_144_12_12": Bicycle(12, 6, ((3, 0), (0, 1), (0, 2)), ((0, 3), (1, 0), (2, 0)), 12, 12),
    "bb_72_12_6": Bicycle(6, 6, ((3, 0), (0, 1), (0, 2)), ((0, 3), (1, 0), (2, 0)), 6, 12),
}
PRESET_IDS = {"bb_144_12_12": "a4f3e8c2-1d5b-4a7f-9e06-3b8c2f1a0d94", "bb_72_12_6": "c7a2d4f1-8e3b-4c69-a1f5-2d9e0b7c3a85"}


def parse_poly(text: str) -> tuple[tuple[int, int], ...]:
    """Offsets written as "di,dj di,dj"."""
    return tuple((int(i), int(j)) for i, j in (pair.split(",") for pair in text.split()))


def check_rows(spark: SparkSession, code: Bicycle) -> DataFrame:
    """row, type (Z or X) and the sorted qubits of every check: Z from [A | B transposed], X from [B | A transposed]."""
    i, j = F.floor(F.col("id") / code.m), F.pmod("id", F.lit(code.m))

    def block(offsets, sign: int, base: int) -> list[Column]:
        return [(base + F.pmod(i + sign * di, F.lit(code.l)) * code.m + F.pmod(j + sign * dj, F.lit(code.m))).cast("int") for di, dj in offsets]

    half = code.l * code.m
    z = F.array_sort(F.array(*block(code.a, -1, 0), *block(code.b, 1, half)))
    x = F.array_sort(F.array(*block(code.b, -1, 0), *block(code.a, 1, half)))
    rows = spark.range(half)
    return rows.select(F.col("id").cast("int").alias("row"), F.lit("Z").alias("type"), z.alias("qubits")).unionByName(rows.select(F.col("id").cast("int").alias("row"), F.lit("X").alias("type"), x.alias("qubits")))


def _rows(code: Bicycle, kind: str) -> list[list[int]]:
    left, right = (code.a, code.b) if kind == "Z" else (code.b, code.a)
    half = code.l * code.m
    at = lambda i, j: i % code.l * code.m + j % code.m
    return [sorted([at(i - di, j - dj) for di, dj in left] + [half + at(i + di, j + dj) for di, dj in right]) for i in range(code.l) for j in range(code.m)]


def csr_base64(rows: list[list[int]], ncols: int) -> str:
    """Rows, columns, entries, row starts and column numbers as 32-bit words, in base 64."""
    starts = [0]
    for r in rows:
        starts.append(starts[-1] + len(r))
    flat = [c for r in rows for c in r]
    return base64.b64encode(struct.pack(f"<{3 + len(starts) + len(flat)}I", len(rows), ncols, len(flat), *starts, *flat)).decode()


def csr_rows(blob: str) -> tuple[list[list[int]], int]:
    words = struct.unpack(f"<{len(raw := base64.b64decode(blob)) // 4}I", raw)
    n, ncols, _ = words[:3]
    starts, flat = words[3 : 4 + n], words[4 + n :]
    return [list(flat[starts[i] : starts[i + 1]]) for i in range(n)], ncols


def _schema(schema_id: str, name: str, description: str, family: str, distance: int, qubits: int, ancillas: int, cycle: float, layout: str, stabilizers: list, **more) -> dict:
    own = [{"id": k, "type": t, "qubits": list(q)} for k, (t, q) in enumerate(stabilizers)]
    base = {"schema_id": schema_id, "version": "1.0.0", "name": name, "description": description, "code_type": family, "distance": distance, "qubit_count": qubits, "ancilla_count": ancillas, "stabilizers": own, "measurement_cycle_us": cycle, "ancilla_layout": layout}
    empty = dict.fromkeys(("ldpc_hz_matrix", "ldpc_hx_matrix", "logical_z", "logical_x", "encoding_rate", "dem_path"))
    return base | empty | more


def from_bicycle(code: Bicycle, name: str, schema_id: str | None = None) -> dict:
    """A schema with Z checks first, then X checks."""
    z, x = _rows(code, "Z"), _rows(code, "X")
    text = f"Bivariate bicycle [[{code.n},{code.logical_qubits},{code.distance}]] code"
    checks = [("Z", r) for r in z] + [("X", r) for r in x]
    return _schema(schema_id or str(uuid.uuid4()), name, text, "bivariate_bicycle", code.distance, code.n, code.n, 1.1, "bivariate_bicycle", checks, ldpc_hz_matrix=csr_base64(z, code.n), ldpc_hx_matrix=csr_base64(x, code.n), encoding_rate=round(code.encoding_rate, 6))


def from_model(model: ErrorModel, name: str) -> dict:
    """One stabilizer for each detector: Z where the rounded coordinates add up to an even number or are missing, else X."""
    half_away = lambda v: int(abs(v) + 0.5) * (1 if v >= 0 else -1)
    kinds = []
    for d in range(model.detector_count):
        at = model.detectors.get(d)
        kinds.append(("Z" if at is None or (half_away(at[0]) + half_away(at[1])) % 2 == 0 else "X", [d]))
    return _schema(str(uuid.uuid4()), name, f"Generated from an error model of {len(model.errors)} errors", "Custom", 0, model.detector_count, model.detector_count, 0.0, "dem", kinds)


def builtins() -> list[dict]:
    return [_schema(*s) for s in SMALL] + [from_bicycle(PRESETS[k], f"bivariate_bicycle_{k[3:]}", PRESET_IDS[k]) for k in PRESETS]


def frame(spark: SparkSession, schemas: list[dict]) -> DataFrame:
    names = [f.split()[0] for f in SCHEMA.replace("array<struct<id:int,type:string,qubits:array<int>>>", "x").split(", ")]
    rows = [tuple([(s["id"], s["type"], s["qubits"]) for s in d[n]] if n == "stabilizers" else d.get(n) for n in names) for d in schemas]
    return spark.createDataFrame(rows, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.json`` of a folder; of a UUID that comes twice the file last by name wins."""
    found = spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).withColumn("_file", F.input_file_name())
    last = Window.partitionBy("schema_id").orderBy(F.desc("_file"))
    return found.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_file")


def upsert(registry: DataFrame, schemas: DataFrame) -> DataFrame:
    """The registry with new schemas in place of those with the same UUID."""
    return registry.join(schemas.select("schema_id"), "schema_id", "left_anti").unionByName(schemas)


def stabilizers(schemas: DataFrame) -> DataFrame:
    """schema_id, position, id, type and qubits of every stabilizer."""
    return schemas.select("schema_id", F.posexplode("stabilizers").alias("position", "s")).select("schema_id", "position", "s.*")
