"""Range join and pick: every candidate is formed, the nearest stays.

Quadratic in the rows of a key; for few rows per key, and to check the others.
Left rows of one key and time have one match, which an aggregation finds that
combines candidates before it exchanges them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.plans.base import R, T, Spec
from timeweave.plans.fill import fill


def nested(left: DataFrame, right: DataFrame, spec: Spec) -> DataFrame:
    if spec.outer:
        return fill(left, right, spec)
    targets = left.select(*spec.keys, F.col(T).alias("__at")).distinct()
    near = {(True, True): F.col(T) <= F.col("__at"), (True, False): F.col(T) < F.col("__at"), (False, True): F.col(T) >= F.col("__at"), (False, False): F.col(T) > F.col("__at")}[spec.backward, spec.exact]
    pairs = targets.join(right, list(spec.keys)).filter(near) if spec.keys else targets.join(right, near)
    groups = [*spec.keys, "__at"]
    if spec.backward:
        picked = pairs.groupBy(*groups).agg(spec.latest().alias(R))
    else:
        picked = pairs.groupBy(*groups, T).agg(F.max_by(R, F.struct(spec.tie)).alias(R)).groupBy(*groups).agg(F.min_by(R, T).alias(R))
    return left.join(picked.withColumnRenamed("__at", T), [*spec.keys, T], "left").select(*left.columns, R)
