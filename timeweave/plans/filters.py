"""Reductions of either side before an inner, left, semi or anti join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.plans.base import T, Spec


def keys_of_other(df: DataFrame, other: DataFrame, spec: Spec) -> DataFrame:
    """Rows whose key the other side has."""
    return df.join(other.select(*spec.keys).distinct(), list(spec.keys), "left_semi") if spec.keys else df


def static_bound(left: DataFrame, right: DataFrame, spec: Spec) -> DataFrame:
    """Left rows that lie beyond every right row can't match; for joins that drop such rows."""
    edge = right.agg((F.min if spec.backward else F.max)(T).alias("edge")).first()["edge"]
    if edge is None:
        return left.limit(0)
    return left.filter(F.col(T) >= F.lit(edge) if spec.backward else F.col(T) <= F.lit(edge))


def dynamic_bound(left: DataFrame, right: DataFrame, spec: Spec) -> DataFrame:
    """Right rows that some left row can see, by key.

    Going backward, let h be the last right time that the key's earliest left row
    sees: right rows before h lose to it for every left row, and rows after the
    key's latest left row are seen by none.  Mirrored for forward.
    """
    ends = left.groupBy(*spec.keys).agg(F.min(T).alias("__a"), F.max(T).alias("__b"))
    rows = right.join(ends, list(spec.keys)) if spec.keys else right.crossJoin(ends)  # one row without keys
    if spec.backward:
        seen = F.col(T) <= F.col("__a") if spec.exact else F.col(T) < F.col("__a")
        horizon = rows.filter(seen).groupBy(*spec.keys).agg(F.max(T).alias("__h"))
        in_reach, useful = F.col(T) <= F.col("__b"), F.col(T) >= F.col("__h")
    else:
        seen = F.col(T) >= F.col("__b") if spec.exact else F.col(T) > F.col("__b")
        horizon = rows.filter(seen).groupBy(*spec.keys).agg(F.min(T).alias("__h"))
        in_reach, useful = F.col(T) >= F.col("__a"), F.col(T) <= F.col("__h")
    rows = rows.filter(in_reach)
    rows = rows.join(horizon, list(spec.keys), "left") if spec.keys else rows.crossJoin(horizon)
    return rows.filter(F.col("__h").isNull() | useful).select(*right.columns)
