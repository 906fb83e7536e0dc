"""Queries of the formats: recordings, messages, vendors' results, schemas, models, datasets and sweep files."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits, codes
from ..operators import decode, sample, threshold
from ..session import shared_dir
from ..sources import dem, frames as wireframes, hardware, shots
from .registry import SQL, query
from .tables import ANCILLAS, FRAMES_SQL, POINTS_SQL, events, frames, model, points, rounded, syndromes

SCHEMA_ID = "0a1b2c3d-0000-4000-8000-00000000002a"
_FIRED = "CAST(len(list_filter(events, lambda e: e)) AS INTEGER)"


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/syndrift/{name}-{uuid.uuid4().hex}"


def _text(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")


# ---- recordings


def _rows(spark, sf) -> DataFrame:
    own = {"round": F.col("frame_id") % 1000, "qubit_count": F.lit(25), "code_type": (F.col("frame_id") % 8 + 1).cast("int"), "distance": F.lit(5)}
    return frames(spark, sf).withColumns(own).drop("ancilla_count", "syndrome")


@query("wire_headers", f"WITH {FRAMES_SQL} SELECT frame_id, frame_id % 1000 AS round, timestamp_ns, 25 AS qubit_count, 24 AS ancilla_count, CAST(frame_id % 8 + 1 AS INTEGER) AS code_type, 5 AS distance, 0 AS flags, '{SCHEMA_ID}' AS schema_id, {_FIRED} AS fired FROM f")
def wire_headers(spark, sf):
    back = wireframes.parse(wireframes.messages(_rows(spark, sf), SCHEMA_ID), mode="failfast")
    return back.select("frame_id", "round", "timestamp_ns", "qubit_count", "ancilla_count", "code_type", "distance", "flags", "schema_id", bits.weight(F.col("events")).alias("fired"))


@query("compressed_messages", f"WITH {FRAMES_SQL} SELECT stream_id, frame_id, timestamp_ns, '{SCHEMA_ID}' AS schema_id, {_FIRED} AS fired FROM f")
def compressed_messages(spark, sf):
    packed = wireframes.messages(_rows(spark, sf), SCHEMA_ID, "frame", compression_level=3)
    back = wireframes.parse(packed, mode="failfast", terminator="frame")
    return back.select("stream_id", "frame_id", "timestamp_ns", "schema_id", bits.weight(F.col("events")).alias("fired"))


def _spoiled(spark, sf) -> DataFrame:
    """Messages by the rest of their frame's number: whole, no magic, version 2, a wrong round, cut, no sentinel."""
    put = lambda c, at, code: F.concat(F.substring(c, 1, at - 1), F.unhex(F.lit(code)), F.expr(f"substring(content, {at + len(code) // 2})"))
    c, kind = F.col("content"), F.col("frame_id") % 6
    tail = F.concat(F.expr("substring(content, 1, length(content) - 6)"), F.unhex(F.lit("0000")), F.expr("substring(content, length(content) - 3)"))
    own = F.when(kind == 1, put(c, 1, "00")).when(kind == 2, put(c, 5, "0200")).when(kind == 3, put(c, 38, "FF")).when(kind == 4, F.substring(c, 1, 72)).when(kind == 5, tail).otherwise(c)
    return wireframes.messages(_rows(spark, sf)).select(F.col("frame_id").cast("string").alias("path"), own.alias("content"))


@query("wire_errors", "SELECT CAST(event_id AS VARCHAR) AS stream_id, CASE event_id % 6 WHEN 2 THEN 'UnsupportedVersion' WHEN 4 THEN 'PayloadLengthMismatch' ELSE 'ChecksumMismatch' END AS kind FROM events WHERE event_id % 6 <> 0")
def wire_errors(spark, sf):
    return wireframes.quarantine(wireframes.parse(_spoiled(spark, sf))).select("stream_id", "kind")


@query("wire_lenient", f"WITH {FRAMES_SQL} SELECT frame_id, frame_id % 1000 + CASE WHEN frame_id % 6 = 3 THEN 4278190080 ELSE 0 END AS round, {_FIRED} AS fired FROM f WHERE frame_id % 6 IN (0, 3, 5)")
def wire_lenient(spark, sf):
    """Read without checks; recordings without their magic are no frames that could be told, and are left out."""
    found = wireframes.good(wireframes.parse(_spoiled(spark, sf).where("path % 6 <> 1"), mode="lenient"))
    return found.select("frame_id", "round", bits.weight(F.col("events")).alias("fired"))


@query("wire_metadata", "SELECT event_id AS frame_id, 'lab-' || user_id % 3 AS hardware_id, CASE WHEN event_id % 2 = 0 THEN event_id % 64 / 4.0::DOUBLE END AS temperature_mk, CASE WHEN event_id % 3 = 0 THEN 1.5::DOUBLE END AS cycle_us, CAST(CASE WHEN event_id % 5 = 0 THEN event_id % 256 END AS INTEGER) AS decoder_hint, -event_id AS observable_flips, 4 AS flags FROM events")
def wire_metadata(spark, sf):
    e = F.col("frame_id")
    meta = F.struct(
        F.concat(F.lit("lab-"), (F.col("stream_id").cast("bigint") % 3).cast("string")).alias("hardware_id"), F.when(e % 2 == 0, e % 64 / 4).alias("temperature_mk"),
        F.when(e % 3 == 0, F.lit(1.5)).alias("cycle_us"), F.when(e % 5 == 0, (e % 256).cast("int")).alias("decoder_hint"), (-e).alias("observable_flips"),
    )
    back = wireframes.parse(wireframes.messages(_rows(spark, sf).withColumn("metadata", meta)), mode="failfast")
    return back.select("frame_id", "metadata.*", "flags")


@query("wire_annotations", "SELECT event_id AS frame_id, CAST(k AS INTEGER) AS logical_id, event_id * (k + 1) AS observable_mask, CAST(k % 2 AS INTEGER) AS frame_basis, 8 AS flags FROM events, (SELECT unnest(range(3)) AS k) WHERE k < event_id % 4")
def wire_annotations(spark, sf):
    note = lambda k: F.struct(k.cast("int").alias("logical_id"), (F.col("frame_id") * (k + 1)).alias("observable_mask"), (k % 2).cast("int").alias("frame_basis"))
    own = F.transform(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: k < F.col("frame_id") % 4), note)
    back = wireframes.parse(wireframes.messages(_rows(spark, sf).withColumn("annotations", own)), mode="failfast")
    return back.select("frame_id", F.explode("annotations").alias("a"), "flags").select("frame_id", "a.*", "flags")


@query("wire_optional_fields", "SELECT event_id AS frame_id, CAST(24 * (event_id % 60000) + 276 AS BIGINT) AS timing, printf('%06X', event_id % 16777216) AS parity, 3 AS flags FROM events")
def wire_optional_fields(spark, sf):
    e = F.col("frame_id")
    timing = F.transform(F.sequence(F.lit(0), F.lit(ANCILLAS - 1)), lambda j: (e % 60000 + j).cast("int"))
    own = _rows(spark, sf).withColumns({"timing_ns": timing, "parity": F.unhex(F.lpad(F.hex(e % 16777216), 6, "0"))})
    back = wireframes.parse(wireframes.messages(own), mode="failfast")
    return back.select("frame_id", F.aggregate("timing_ns", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("timing"), F.hex("parity").alias("parity"), "flags")


@query("packed_bytes", f"WITH {FRAMES_SQL} SELECT frame_id, array_to_string([printf('%02X', CAST(list_sum([CASE WHEN events[g * 8 + j + 1] THEN 1 << j ELSE 0 END for j in range(8)]) AS BIGINT)) for g in range(3)], '') AS code FROM f")
def packed_bytes(spark, sf):
    return frames(spark, sf).select("frame_id", F.hex(bits.pack_bytes(F.col("events"))).alias("code"))


# ---- vendors' results


def _documents(spark, sf, observables: bool = True) -> str:
    """A JSON document for each stream: its outcomes in the order of frames, and one observable a shot."""
    own = F.struct("frame_id", F.transform("events", lambda e: e.cast("int")).alias("m"), F.array(F.col("ground_truth").cast("int")).alias("o"))
    rows = frames(spark, sf).groupBy("stream_id").agg(F.array_sort(F.collect_list(own)).alias("r"))
    fields = [F.col("r.m").alias("meas")] + ([F.col("r.o").alias("obs")] if observables else [])
    path = _folder(spark, "json")
    rows.select(F.to_json(F.struct(*fields)).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


_JSON = "WITH {f} SELECT row_number() OVER (PARTITION BY stream_id ORDER BY frame_id) - 1 AS frame_id, 24 AS ancilla_count, {fired} AS fired, {flips} AS observable_flips FROM f"


def _shots(rows: DataFrame) -> DataFrame:
    return rows.select("frame_id", "ancilla_count", bits.weight(F.col("events")).alias("fired"), "observable_flips")


@query("json_shots", _JSON.format(f=FRAMES_SQL, fired=_FIRED, flips="ground_truth"))
def json_shots(spark, sf):
    return _shots(shots.read_json(spark, _documents(spark, sf), "meas", "obs"))


@query("json_shots_without_observables", _JSON.format(f=FRAMES_SQL, fired=_FIRED, flips="CAST(NULL AS BIGINT)"))
def json_shots_without_observables(spark, sf):
    return _shots(shots.read_json(spark, _documents(spark, sf, False), "meas", "obs", strict=False))


@query("converted_shots", f"WITH {FRAMES_SQL} SELECT row_number() OVER (PARTITION BY stream_id ORDER BY frame_id) - 1 AS frame_id, {_FIRED} AS fired, ground_truth AS flips FROM f")
def converted_shots(spark, sf):
    rows = shots.read_json(spark, _documents(spark, sf), "meas", "obs").withColumn("stream_id", F.lit("json"))
    back = wireframes.parse(wireframes.messages(rows, SCHEMA_ID), mode="failfast")
    return back.select("frame_id", bits.weight(F.col("events")).alias("fired"), F.col("metadata.observable_flips").alias("flips"))


@query("bit_strings", "SELECT * FROM (VALUES (0::BIGINT, '0,2', 1::BIGINT), (1, '', 0), (2, '1,2,3', 1)) t(frame_id, fired, observable_flips)")
def bit_strings(spark, sf):
    rows = shots.from_arrays(spark, shots.bits_from_strings(["1010", "0000", "0111"]), [[1], [0], [1]])
    return rows.select("frame_id", _text(bits.active(F.col("events"))).alias("fired"), "observable_flips")


@query("bit_bytes", "SELECT * FROM (VALUES (0::BIGINT, '0,9', 10), (1, '7,8', 10)) t(frame_id, fired, ancilla_count)")
def bit_bytes(spark, sf):
    rows = shots.from_arrays(spark, shots.bits_from_bytes([[0x80, 0x40], [0x01, 0xBF]], 10))
    return rows.select("frame_id", _text(bits.active(F.col("events"))).alias("fired"), "ancilla_count")


@query("pub_results", "SELECT * FROM (VALUES (0, 0::BIGINT, '0', 2::BIGINT), (0, 1, '1', 0), (1, 0, '0,1', 1)) t(pub, frame_id, fired, observable_flips)")
def pub_results(spark, sf):
    pubs = [{"meas": [[1, 0], [0, 1]], "obs": [[0, 1], [0, 0]]}, {"meas": [[1, 1]], "obs": [[1, 0]]}]
    return shots.from_pubs(spark, pubs, "meas", "obs").select("pub", "frame_id", _text(bits.active(F.col("events"))).alias("fired"), "observable_flips")


@query("simulator_results", "SELECT * FROM (VALUES (0::BIGINT, 3, '1', NULL::BIGINT), (1, 3, '', NULL)) t(frame_id, round, fired, observable_flips)")
def simulator_results(spark, sf):
    rows = shots.from_simulator(spark, {"m": np.array([[0, 1], [0, 0]])}, "m", "missing", 3)
    return rows.select("frame_id", "round", _text(bits.active(F.col("events"))).alias("fired"), "observable_flips")


# ---- schemas, codes and models


@query("schema_folder", "SELECT * FROM (VALUES ('surface', 3::BIGINT, 14::BIGINT), ('honeycomb', 1, 6), ('color', 1, 6), ('repetition', 1, 6), ('bivariate_bicycle', 2, 216)) t(code_type, schemas, stabilizers)")
def schema_folder(spark, sf):
    path = _folder(spark, "schemas")
    for own in hardware.builtins():
        hardware.frame(spark, [own]).coalesce(1).write.mode("append").json(path)
    return hardware.read(spark, path).groupBy("code_type").agg(F.count("*").alias("schemas"), F.sum(F.size("stabilizers").cast("bigint")).alias("stabilizers"))


@query("code_types", "SELECT * FROM (VALUES (1, 'SURFACE_CODE'), (2, 'HONEYCOMB_CODE'), (3, 'COLOR_CODE'), (4, 'REPETITION_CODE'), (5, 'TORIC_CODE'), (6, 'BIVARIATE_BICYCLE'), (7, 'HYPERGRAPH_PRODUCT'), (8, 'FIBER_BUNDLE'), (255, 'CUSTOM')) t(code_type, name)")
def code_types(spark, sf):
    return codes.code_types(spark)


def _preset(name: str) -> None:
    c = hardware.PRESETS[f"bb_{name}"]
    poly = lambda offsets: " ".join(f"{i},{j}" for i, j in offsets)

    def made() -> dict:
        return hardware.from_bicycle(hardware.Bicycle(c.l, c.m, hardware.parse_poly(poly(c.a)), hardware.parse_poly(poly(c.b)), c.distance, c.logical_qubits), name)

    rows = SQL[f"check_rows_{name}"]

    @query(f"bicycle_schema_{name}", f"SELECT CAST(row + CASE type WHEN 'X' THEN {c.l * c.m} ELSE 0 END AS INTEGER) AS id, type, qubits FROM ({rows})")
    def stabilizers(spark, sf):
        return hardware.stabilizers(hardware.frame(spark, [made()])).select("id", "type", _text(F.col("qubits")).alias("qubits"))

    @query(f"csr_rows_{name}", f"SELECT row, type, qubits, {c.n} AS columns FROM ({rows})")
    def matrix(spark, sf):
        own, out = made(), []
        for kind, key in (("Z", "ldpc_hz_matrix"), ("X", "ldpc_hx_matrix")):
            held, columns = hardware.csr_rows(own[key])
            out += [(k, kind, ",".join(map(str, r)), columns) for k, r in enumerate(held)]
        return spark.createDataFrame(out, "row int, type string, qubits string, columns int")


_GRAMMAR = """# a comment
error(0.1) D0 D1 ^ L0

repeat 2 {
  error(0.2) D2
  detector(1,2,3) D4
}
repeat 3 { error(0.25) D3 }
unknown D9
logical_observable L5
"""


@query("model_grammar", "SELECT * FROM (VALUES (0::BIGINT, 0.1::DOUBLE, '0,1', '0', 5, 6), (1, 0.2, '2', '', 5, 6), (2, 0.2, '2', '', 5, 6), (3, 0.25, '3', '', 5, 6), (4, 0.25, '3', '', 5, 6), (5, 0.25, '3', '', 5, 6)) t(seq, p, detectors, observables, detector_count, observable_count)")
def model_grammar(spark, sf):
    m = dem.parse(_GRAMMAR)
    rows = dem.tables(spark, m)[0].select("seq", "p", _text(F.col("detectors")).alias("detectors"), _text(F.col("observables")).alias("observables"))
    return rows.withColumns({"detector_count": F.lit(m.detector_count), "observable_count": F.lit(m.observable_count)})


_WRONG = ["error(x) D0", "error(0.1 D0", "error(0.1) Q0", "detector(1,2 D0", "detector(1,2)", "repeat many {", "repeat 2 {\nerror(0.1) D0", "error(0.1) L256"]


@query("model_errors", "SELECT * FROM (VALUES (0, 'InvalidProbability'), (1, 'InvalidProbability'), (2, 'MalformedTarget'), (3, 'MalformedCoords'), (4, 'MalformedTarget'), (5, 'InvalidRepeatCount'), (6, 'UnterminatedRepeat'), (7, 'MalformedTarget')) t(line, kind)")
def model_errors(spark, sf):
    def kind(text: str) -> str | None:
        try:
            dem.parse(text)
        except dem.ModelError as e:
            return e.kind

    return spark.createDataFrame([(i, kind(t)) for i, t in enumerate(_WRONG)], "line int, kind string")


# ---- decoders, datasets and sweep files


@query("proxy_decoder", f"WITH {FRAMES_SQL} SELECT frame_id, CAST(syndrome <> 0 AS BIGINT) AS observable_flips, 1.0::DOUBLE AS confidence FROM f")
def proxy_decoder(spark, sf):
    return decode.decoded(syndromes(spark, sf), lambda: decode.Proxy(3, 1)).select("frame_id", "observable_flips", "confidence")


def _drawn(spark, sf) -> DataFrame:
    return sample.sample(spark, dem.tables(spark, model())[0], events(spark, sf).count())


def _sampled_queries() -> None:
    drawn_sql = SQL["sample_shots"]

    @query("dataset_round_trip", drawn_sql)
    def dataset_round_trip(spark, sf):
        back = shots.parse_ssds(shots.ssds_blocks(_drawn(spark, sf), 3, 1, 1000))
        return back.select((F.col("block") * 1000 + F.col("shot")).alias("shot"), "observable_flips", _text(bits.active(F.col("events"))).alias("fired"))

    @query("simulated_frames", drawn_sql)
    def simulated_frames(spark, sf):
        fired = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.array_contains("active", i))
        rows = _drawn(spark, sf).select(F.lit("sampled").alias("stream_id"), F.col("shot").alias("frame_id"), fired.alias("events"), "observable_flips")
        back = wireframes.parse(wireframes.messages(rows), mode="failfast")
        return back.select(F.col("frame_id").alias("shot"), F.col("metadata.observable_flips").alias("observable_flips"), _text(bits.active(F.col("events"))).alias("fired"))


_POINTS = f"WITH {POINTS_SQL} SELECT distance, p_physical, shots, logical_errors, round(p_l, 8) AS p_l, round(p_l_err, 8) AS p_l_err FROM pts"


@query("threshold_csv", _POINTS)
def threshold_csv(spark, sf):
    path = _folder(spark, "csv")
    threshold.write_csv(points(spark, sf), path)
    return rounded(threshold.read_any(spark, path), 8)


@query("threshold_json", _POINTS)
def threshold_json(spark, sf):
    path = _folder(spark, "points") + ".json"
    threshold.write_json(points(spark, sf), path)
    return rounded(threshold.read_any(spark, path), 8)


@query("threshold_svg", f"WITH {POINTS_SQL} SELECT CAST(distance AS INTEGER) AS distance, CAST(count(*) AS INTEGER) AS points FROM pts WHERE p_l > 0 AND p_physical > 0 GROUP BY 1")
def threshold_svg(spark, sf):
    text = spark.createDataFrame([(threshold.svg(points(spark, sf)),)], "svg string")
    line = text.select(F.explode(F.regexp_extract_all("svg", F.lit(r"(?s)(<polyline.*?</polyline>)"))).alias("line"))
    return line.select(F.regexp_extract("line", "d=([0-9]+)", 1).cast("int").alias("distance"), F.size(F.split(F.regexp_extract("line", 'points="([^"]*)"', 1), " ")).alias("points"))


for _name in ("72_12_6", "144_12_12"):
    _preset(_name)
_sampled_queries()
