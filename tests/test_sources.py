import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from syndrift.cli import main
from syndrift.functions import bits
from syndrift.operators import metrics, threshold, windows
from syndrift.plans.tables import REPETITION
from syndrift.sources import dem, frames, hardware, shots, wire


def test_text_shots(spark, tmp_path):
    (tmp_path / "a.01").write_text("0110\n1001\n\n0000\n01x111\n1\n")
    got = [(r.frame_id, list(r.meas)) for r in shots.read_01(spark, str(tmp_path / "a.01")).orderBy("frame_id").collect()]
    assert got == [(0, [1, -1, -1, 1]), (1, [-1, 1, 1, -1]), (2, [1, 1, 1, 1]), (3, [1, -1, 1, -1]), (4, [-1, 1, 1, 1])]
    (tmp_path / "o.01").write_text("10\n01\n" + "0" * 63 + "11\n")
    obs = shots.read_observables(spark, str(tmp_path / "o.01"))
    assert [r.observable_flips for r in obs.orderBy("frame_id").collect()] == [1, 2, -(1 << 63)]
    both = shots.with_observables(shots.read_01(spark, str(tmp_path / "a.01")), obs).orderBy("frame_id").collect()
    assert [r.observable_flips for r in both] == [1, 2, -(1 << 63), None, None]


def test_json_shots(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"meas": [[0, 1], [1, 1]], "obs": [[1], [0]]}))
    rows = shots.read_json(spark, str(p), observable_register="obs").orderBy("frame_id").collect()
    assert [(list(r.events), r.observable_flips) for r in rows] == [([False, True], 1), ([True, True], 0)]
    with pytest.raises(KeyError):
        shots.read_json(spark, str(p), "nope")
    with pytest.raises(KeyError):
        shots.read_json(spark, str(p), observable_register="nope")
    assert shots.read_json(spark, str(p), observable_register="nope", strict=False).count() == 2


def test_vendor_arrays(spark):
    assert shots.from_arrays(spark, [0, 1, 1]).count() == 1
    pubs = shots.from_pubs(spark, [{"meas": [[0, 1]], "o": [[1, 1]]}, {"meas": [[1, 1]], "o": [[0, 1]]}], "meas", "o").orderBy("pub").collect()
    assert [(r.pub, r.frame_id, r.observable_flips) for r in pubs] == [(0, 0, 3), (1, 0, 2)]
    assert shots.bits_from_bytes([[0b10100000]], 3).tolist() == [[1, 0, 1]]
    assert shots.bits_from_strings(["01"]) == [[0, 1]]
    assert shots.from_simulator(spark, {"m": [[1]]}, "m", "missing").first().observable_flips is None


def test_ssds(spark, tmp_path):
    x, y = np.array([[0, 1], [1, 1]], np.uint8), np.array([1, 1 << 63], np.uint64)
    (tmp_path / "d.ssds").write_bytes(shots.encode_ssds(x, y, 1))
    rows = shots.read_ssds(spark, str(tmp_path / "d.ssds")).orderBy("shot").collect()
    assert [(list(r.events), r.observable_flips) for r in rows] == [([False, True], 1), ([True, True], -(1 << 63))]


def test_frames_through_files(spark, tmp_path):
    base = frames.synthetic(spark, 200, 0.05)
    for k, options in enumerate(({}, {"terminator": "frame", "compression_level": 3})):
        out = str(tmp_path / f"o{k}")
        frames.write(base.repartition(3), out, **options)
        for back in (frames.read(spark, out, ordered=True, terminator=options.get("terminator", "header")), spark.read.format("frames").option("terminator", options.get("terminator", "header")).load(out)):
            assert frames.quarantine(back).count() == 0
            assert back.selectExpr("frame_id", "events", "meas", "timestamp_ns").exceptAll(base.select("frame_id", "events", "meas", "timestamp_ns")).count() == 0
            assert back.count() == 200


def test_broken_file(spark, tmp_path):
    good = wire.encode_frame(wire.Frame(0, events=[True], ancilla_count=1, meas=[1]))
    (tmp_path / "x.bin").write_bytes(wire.file_header() + good + good)
    got = frames.read(spark, str(tmp_path))
    assert frames.good(got).count() == 1 and frames.quarantine(got).first().kind == "FrameOutOfOrder"
    assert frames.read(spark, str(tmp_path), mode="lenient").count() == 2
    with pytest.raises(Exception, match="FrameOutOfOrder"):
        frames.read(spark, str(tmp_path), mode="failfast").collect()


def test_bits(spark):
    cases = [[], [True], [False] * 300, [True] * 130 + [False], [True, False] * 9]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, e array<boolean>")
    code = bits.rle_encode(F.col("e"))
    for r in df.select("i", code.alias("c"), bits.rle_popcount(code).alias("n"), bits.rle_decode(code).alias("d"), bits.rle_bit(code, 0).alias("b"), bits.pack_bytes(F.col("e")).alias("p")).collect():
        e = cases[r.i]
        assert bytes(r.c) == wire.rle_encode(e) and r.n == sum(e) and list(r.d) == e and r.b == (int(e[0]) if e else 0)
        assert bytes(r.p) == np.packbits(np.array(e, bool), bitorder="little").tobytes()


def test_registry(spark, tmp_path):
    own = hardware.builtins()
    assert len(own) == 8 and len({s["schema_id"] for s in own}) == 8
    for k, s in enumerate([own[1], own[1] | {"version": "2"}]):
        (tmp_path / f"{k}.json").write_text(json.dumps(s))
    (tmp_path / "x.txt").write_text("no")
    got = hardware.read(spark, str(tmp_path)).collect()
    assert [(r.name, r.version) for r in got] == [("surface_code_d5", "2")]


def test_points(spark, tmp_path):
    rows = [(3, 0.1, 0.05, 0.001, 100, 5), (3, 0.2, 0.15, 0.001, 100, 15), (5, 0.1, 0.02, 0.0, 100, 2), (5, 0.2, 0.2, 0.0, 100, 20)]
    pts = spark.createDataFrame(rows, threshold.POINT)
    at = spark.createDataFrame([(3, 0.05), (3, 0.15), (3, 0.25)], "distance int, p double")
    assert [round(r.p_l_at, 9) for r in threshold.at_rate(pts, at).orderBy("p").collect()] == [0.05, 0.1, 0.15]
    assert threshold.crossings(pts).first().p_cross == pytest.approx(0.1375)
    threshold.write_csv(pts, str(tmp_path / "c.csv"))
    threshold.write_json(pts, str(tmp_path / "c.json"))
    for p in ("c.csv", "c.json"):
        assert threshold.read_any(spark, str(tmp_path / p)).orderBy("distance", "p_physical").collect() == pts.collect()
    threshold.write_svg(pts, str(tmp_path / "p.svg"))
    assert "polyline" in (tmp_path / "p.svg").read_text()
    with pytest.raises(ValueError):
        threshold.union([pts.limit(0)], ["a"])
    with pytest.raises(ValueError):
        threshold.sweep(spark, [dem.parse(REPETITION)], [3, 5])


def test_one_hot_stream(spark):
    base = frames.synthetic(spark, 500, 0.05).where("frame_id % 97 <> 5")
    a = windows.sliding(base, 4).select("end_frame_id", "active")
    b = windows.sliding(base, 4, ranges=150).select("end_frame_id", "active")
    assert sorted(a.collect()) == sorted(b.collect())


def test_percentiles(spark):
    df = spark.range(1, 11).withColumnRenamed("id", "x")
    assert metrics.nearest_rank(df, "x", 50).first()[0] == 5 and metrics.nearest_rank(df.limit(0), "x", 50).first()[0] == 0
    assert metrics.floor_rank(df, "x", 50).first()[0] == 6
    got = df.select(metrics.power_bucket(F.col("x") - 1, 8).alias("b")).collect()
    assert [r.b for r in got][:9] == [0, 0, 1, 1, 2, 2, 2, 2, 3]


def test_command_line(spark, tmp_path, capsys):
    model = tmp_path / "m.dem"
    model.write_text(REPETITION)
    assert main(["simulate", "--dem", str(model), "--shots", "60", "--out", str(tmp_path / "sim")]) == 0
    assert main(["analyze", "--input", str(tmp_path / "sim"), "--dem", str(model), "--decoder", "uf", "--window-depth", "1", "--output", str(tmp_path / "r.json")]) == 0
    assert json.loads((tmp_path / "r.json").read_text())["frames"] == 60
    assert main(["run", "--dem", str(model), "--distance", "3", "--shots", "300", "--out", str(tmp_path / "t.csv")]) == 0
    assert main(["dataset", "--dem", str(model), "--shots", "20", "--out", str(tmp_path / "d.ssds")]) == 0
    assert shots.decode_ssds((tmp_path / "d.ssds").read_bytes())[0].shape == (20, 3)
    assert main(["ldpc", "--preset", "bb_72_12_6"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["ancilla_count"] == 72
