import random

from syndrift.operators import metrics


def test_floor_rank_equals_sorting(spark):
    rng = random.Random(3)
    for values in ([5], [7, 7, 7], [rng.randrange(-50, 50) for _ in range(301)], [rng.choice([0, 10**15, 3]) for _ in range(100)], [2**40 + i for i in range(2500)]):
        df = spark.createDataFrame([(v,) for v in values], "x bigint")
        for p in (0, 50, 99, 100):
            assert metrics.floor_rank(df, "x", p).first().value == sorted(values)[min(len(values) * p // 100, len(values) - 1)]
    assert metrics.floor_rank(df.limit(0), "x", 50).first().value == 0
