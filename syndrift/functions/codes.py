"""Code families, and small classifications as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Discriminants of code families, and the names by which hardware schemas call them.
CODE_TYPES = {
    "SURFACE_CODE": 1,
    "HONEYCOMB_CODE": 2,
    "COLOR_CODE": 3,
    "REPETITION_CODE": 4,
    "TORIC_CODE": 5,
    "BIVARIATE_BICYCLE": 6,
    "HYPERGRAPH_PRODUCT": 7,
    "FIBER_BUNDLE": 8,
    "CUSTOM": 255,
}
CODE_NAMES = {
    "surface": 1,
    "surface_code": 1,
    "honeycomb": 2,
    "honeycomb_code": 2,
    "color": 3,
    "color_code": 3,
    "repetition": 4,
    "repetition_code": 4,
    "toric": 5,
    "toric_code": 5,
    "bivariate_bicycle": 6,
    "hypergraph_product": 7,
    "fiber_bundle": 8,
    "custom": 255,
}


def code_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v, k) for k, v in CODE_TYPES.items()], "code_type int, name string")


def code_number(name: Column) -> Column:
    """Discriminant of a schema's code name; null if unknown.  Names are case-sensitive."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in CODE_NAMES.items() for x in pair)), name)


def known_code(number: Column) -> Column:
    return number.isin(*CODE_TYPES.values())


def cluster_bucket(size: Column) -> Column:
    """1: up to one fired ancilla, 2: two or three, 3: four or five, 4: more."""
    return F.when(size <= 1, 1).when(size <= 3, 2).when(size <= 5, 3).otherwise(4)


def heat_class(rate: Column, z: Column) -> Column:
    return (
        F.when(z < -2.5, "underactive").when(z > 3, "severe").when(z > 2, "high")
        .when(rate > 0.15, "hot").when(rate > 0.08, "warm").when(rate < 0.001, "silent").otherwise("ok")
    )


def gauge_class(p_l: Column) -> Column:
    return F.when(p_l < 0.01, "good").when(p_l < 0.05, "warn").otherwise("bad")


def gauge_fill(p_l: Column) -> Column:
    return F.least(20 * p_l, F.lit(1.0))
