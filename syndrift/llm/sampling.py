"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place() -> Column:
    """A number in [0, 1] fixed by doc_id."""
    return F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5


def share(n: int, total: int) -> float:
    """The share of ``total`` hashed ids that holds the ``n`` smallest, but for one time in a million."""
    return min(1.0, (n + 5 * n**0.5 + 50) / max(total, 1))


def smallest(rows: DataFrame, n: int, total: int | None = None) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashed doc_id.

    Rows over the share are left out where they are read, so about ``n`` rows come together in all, however many
    partitions there are.
    """
    total = rows.count() if total is None else total
    return rows.where(place() <= share(n, total)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
