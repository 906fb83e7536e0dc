"""Command line: ``python -m syndrift COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys
import threading

import numpy as np
from pyspark.sql import functions as F

from .operators import decode, metrics, plugins, sample, threshold, windows
from .operators.graph import Graph
from .session import session
from .sources import dem, frames, hardware, shots, wire
from .streaming import server


def _model(path: str) -> dem.ErrorModel:
    with open(path) as f:
        return dem.parse(f.read())


def analyze(a) -> int:
    spark = session("analyze")
    held = frames.good(frames.read(spark, a.input, mode="lenient"))
    held = held.withColumn("ground_truth", F.col("metadata.observable_flips"))
    width = held.agg(F.min_by("ancilla_count", "frame_id")).first()[0] or 0
    graph = Graph.of(_model(a.dem)) if a.dem else None
    if graph is None and a.decoder != "null":
        raise SystemExit("this decoder needs --dem")
    decoded = decode.decoded(windows.sliding(held, a.window_depth), a.decoder, graph)
    report = metrics.analysis(held, decoded, width, a.observable_count)
    text = metrics.to_json(report).first()[0]
    if a.output:
        with open(a.output, "w") as out:
            out.write(text + "\n")
    else:
        print(text)
    if a.verbose:
        print(metrics.summary(report).first()[0], file=sys.stderr)
    return 0


def sweep(a) -> int:
    spark = session("sweep")
    points = threshold.sweep(spark, [_model(p) for p in a.dem], a.distance, a.p_physical, a.decoder, a.shots, a.observable_count, a.seed)
    points = points.persist()
    (threshold.write_json if a.out.endswith(".json") else threshold.write_csv)(points, a.out)
    if a.plot:
        threshold.write_svg(points, a.plot)
    if a.verbose:
        points.show(truncate=False)
    return 0


def compare(a) -> int:
    spark = session("compare")
    points = threshold.union([threshold.read_any(spark, p) for p in a.input], a.label or a.input).persist()
    threshold.estimate(points).show(truncate=False)
    if a.plot:
        threshold.write_svg(points, a.plot)
    if a.out:
        (threshold.write_json if a.out.endswith(".json") else threshold.write_csv)(points.drop("label"), a.out)
    return 0


def convert(a) -> int:
    spark = session("convert")
    if a.kind == "text":
        rows = shots.read_01(spark, a.input)
        if a.observables:
            rows = shots.with_observables(rows, shots.read_observables(spark, a.observables))
    else:
        reg = {"register": a.register, "observable_register": a.observable_register, "strict": a.kind == "qiskit"}
        rows = shots.read_json(spark, a.input, **reg)
    if rows.isEmpty():
        print("no frames", file=sys.stderr)
        return 1
    frames.write(rows.coalesce(1), a.out, a.schema_id)
    return 0


def dataset(a) -> int:
    model = _model(a.dem)
    spark = session("dataset")
    drawn = sample.sample_fast(spark, model, a.shots, a.seed)
    if not a.out.endswith(".ssds"):
        drawn.write.mode("overwrite").parquet(a.out)
        return 0
    rows = drawn.orderBy("shot").toLocalIterator(prefetchPartitions=True)
    x, y = np.zeros((a.shots, model.detector_count), np.uint8), np.zeros(a.shots, np.uint64)
    for r in rows:
        x[r.shot, r.active] = 1
        y[r.shot] = wire.unsigned(r.observable_flips)
    with open(a.out, "wb") as out:
        out.write(shots.encode_ssds(x, y, model.observable_count))
    return 0


def _sampler(a):
    """Of an error model, or of a circuit that an external program samples."""
    if bool(a.dem) == bool(a.circuit):
        raise SystemExit("either --dem or --circuit is needed")
    if a.dem:
        return sample.Sampler(_model(a.dem))
    with open(a.circuit) as f:
        return plugins.Circuit(a.program, f.read())


def simulate(a) -> int:
    sampler = _sampler(a)
    spark = session("simulate")
    n = sampler.detectors if a.dem else sampler.draw(1, np.random.default_rng(a.seed))[0].shape[1]
    drawn = sample.sample_with(spark, sampler, a.shots, a.seed)
    events = F.transform(F.slice(F.sequence(F.lit(0), F.lit(n)), 1, n), lambda i: F.array_contains("active", i))
    frames.write(drawn.select(F.col("shot").alias("frame_id"), events.alias("events"), "observable_flips"), a.out)
    return 0


def serve(a) -> int:
    """Frames for every client that connects, until interrupted."""
    with server.serve(_sampler(a), a.shots, a.host, a.port, a.seed, a.rate) as running:
        print(running.address, flush=True)
        try:
            threading.Event().wait()
        except KeyboardInterrupt:
            return 0


def ldpc(a) -> int:
    code = hardware.PRESETS[a.preset] if a.preset else hardware.Bicycle(a.l, a.m, hardware.parse_poly(a.poly_a), hardware.parse_poly(a.poly_b), a.distance, a.k)
    text = json.dumps(hardware.from_bicycle(code, a.name or (a.preset or "custom")), indent=2 if a.pretty else None)
    if a.out:
        with open(a.out, "w") as out:
            out.write(text + "\n")
    else:
        print(text)
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="syndrift")
    sub = top.add_subparsers(required=True)

    def command(name: str, run, /, **options) -> None:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flag, kw in options.items():
            p.add_argument("--" + flag.replace("_", "-"), **kw)

    flag, many = {"action": "store_true"}, {"nargs": "+", "required": True}
    command("analyze", analyze, input={"required": True}, dem={}, decoder={"default": "null", "choices": sorted(decode.DECODERS)}, window_depth={"type": int, "default": 5}, observable_count={"type": int, "default": 1}, output={}, verbose=flag)
    command("run", sweep, dem=many, distance=many | {"type": int}, p_physical={"nargs": "*", "type": float}, decoder={"default": "union-find"}, shots={"type": int, "default": 100_000}, observable_count={"type": int, "default": 1}, seed={"type": int, "default": 42}, out={"default": "threshold.csv"}, plot={}, verbose=flag)
    command("compare", compare, input=many, label={"nargs": "*"}, plot={}, out={})
    command("convert", convert, kind={"choices": ["text", "qiskit", "cirq"], "default": "text"}, input={"required": True}, observables={}, register={"default": "meas"}, observable_register={}, schema_id={"default": wire.NO_SCHEMA}, out={"required": True})
    command("dataset", dataset, dem={"required": True}, shots={"type": int, "default": 100_000}, seed={"type": int, "default": 42}, out={"required": True})
    circuit = {"dem": {}, "circuit": {}, "program": {"default": "stim"}}
    command("serve", serve, **circuit, shots={"type": int, "default": 10_000}, seed={"type": int}, host={"default": "127.0.0.1"}, port={"type": int, "default": 9000}, rate={"type": float})
    command("simulate", simulate, **circuit, shots={"type": int, "default": 10_000}, seed={"type": int, "default": 42}, out={"required": True})
    command("ldpc", ldpc, preset={"choices": sorted(hardware.PRESETS)}, l={"type": int}, m={"type": int}, poly_a={}, poly_b={}, distance={"type": int, "default": 0}, k={"type": int, "default": 0}, name={}, out={}, pretty=flag)
    a = top.parse_args(argv)
    return a.run(a)
