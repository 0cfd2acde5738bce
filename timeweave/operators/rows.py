"""Row operators around the join: first rows, forward fill, searches, reordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.operators.asof import asof_join


def first_n(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in the given order."""
    return df.orderBy(*order).limit(n)


def shuffled(df: DataFrame, seed: int = 0) -> DataFrame:
    """The same rows in a random order."""
    return df.orderBy(F.rand(seed))


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """``name``: the last non-null ``column`` up to the row, per key."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(column, ignorenulls=True).over(window))


def latest_at_or_before(targets: DataFrame, data: DataFrame, on: Sequence[str], left_time: str, right_time: str, **options) -> DataFrame:
    """Each target with the last entry <= it, null where there is none; searched in sorted arrays where ``data`` is small."""
    return asof_join(targets, data, on, left_time, right_time, "backward", how="left", **{"strategy": "probe_right"} | options)


def earliest_at_or_after(targets: DataFrame, data: DataFrame, on: Sequence[str], left_time: str, right_time: str, **options) -> DataFrame:
    """Each target with the first entry >= it, null where there is none; searched in sorted arrays where ``data`` is small."""
    return asof_join(targets, data, on, left_time, right_time, "forward", how="left", **{"strategy": "probe_right"} | options)


def with_known_keys(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key the other table has."""
    return df.join(other.select(*on).distinct(), list(on), "left_semi")
