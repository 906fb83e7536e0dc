import pytest
from oracle import compare

import __spark_entry__
from syndrift.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.SQL[name], SF)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sweep_is_reproducible(spark):
    a, b = (catalogue.QUERIES["threshold_sweep"](spark, SF).orderBy("p_physical").collect() for _ in range(2))
    assert a == b and [r.p_l for r in a] == sorted(r.p_l for r in a)
