import importlib.util

import numpy as np
import pytest

from syndrift.operators import decode, plugins
from syndrift.operators.graph import Graph
from syndrift.plans.tables import REPETITION
from syndrift.sources import dem


def test_missing_package_is_named():
    if importlib.util.find_spec("pymatching"):
        pytest.skip("installed")
    with pytest.raises(ImportError, match="pymatching"):
        plugins.PyMatching(Graph.of(dem.parse(REPETITION)))


def test_program(tmp_path):
    fake = tmp_path / "fake"
    fake.write_text('#!/bin/sh\nfor a in "$@"; do case "$p" in --in) i=$a;; --out) o=$a;; esac; p=$a; done\ncp "$i" "$o"\n')
    fake.chmod(0o755)
    assert plugins.Program(str(fake), "", 3, 2).decode(np.array([1, 2])) == (2, 1.0)


def test_own_decoder(spark):
    class Parity:
        def decode(self, active):
            return len(active) % 2, 0.5

    decode.register("parity", lambda graph: Parity())
    df = spark.createDataFrame([([0, 1, 2],), ([],), ([1, 2],)], "active array<int>")
    got = {tuple(r.active): (r.observable_flips, r.confidence) for r in decode.decoded(df, "parity").collect()}
    assert got == {(0, 1, 2): (1, 0.5), (): (0, 1.0), (1, 2): (0, 0.5)}
