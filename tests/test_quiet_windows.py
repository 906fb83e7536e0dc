import pytest

from syndrift.operators import decode


@pytest.mark.parametrize("score", [0.25, 0.75])
def test_models_are_asked_about_quiet_windows(spark, score):
    df = spark.createDataFrame([(0, []), (1, [0]), (2, []), (3, None)], "w int, active array<int>")
    got = {r.w: (r.observable_flips, r.confidence) for r in decode.decoded(df, lambda: decode.Neural(lambda x: [score], 3)).collect()}
    assert got == {0: (int(score > 0.5), 0.75), 1: (int(score > 0.5), 0.75), 2: (int(score > 0.5), 0.75), 3: (0, 1.0)}
