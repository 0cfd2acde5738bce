"""Fill in time buckets, for keys (or no key at all) too large for one task.

Time is cut at approximate quantiles, into buckets of about ``ROWS`` rows.  Each
(key, bucket) is filled by itself; what it needs from its neighbours is the last
right row of the earlier buckets and the side of the next bucket's first row,
found on one row per (key, bucket).  Equal times always share a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from timeweave.plans.base import R, SIDE, T, Spec, finished, timeline

#: Rows of a bucket in the mean, and the least and greatest number of buckets.
ROWS, BUCKETS, MOST_BUCKETS, BUCKET = 1_000_000, 64, 1 << 14, "__bucket"
BUCKETABLE = (NumericType, DateType, TimestampType, TimestampNTZType)


def as_number(df: DataFrame) -> Column:
    """The time as a double that keeps its order (equal doubles may hide small differences)."""
    kind = df.schema[T].dataType
    if isinstance(kind, NumericType):
        return F.col(T).cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(T).cast("double")
    if isinstance(kind, TimestampType | TimestampNTZType):
        return F.unix_micros(F.col(T).cast("timestamp")).cast("double")
    raise TypeError(f"bucketed needs a numeric, date or timestamp column, not {kind.simpleString()}")


def how_many(rows: int) -> int:
    return min(MOST_BUCKETS, max(BUCKETS, -(-rows // ROWS)))


def bucket_of(number: Column, cuts: list[float]) -> Column:
    """How many cuts are at or under the number, by binary search in a literal array."""
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(float(c)) for c in cuts])
    jumps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    inside = lambda at: (at <= len(cuts)) & F.coalesce(F.get(bounds, at - 1) <= number, F.lit(False))
    return F.aggregate(jumps, F.lit(0), lambda at, jump: F.when(inside(at + jump), at + jump).otherwise(at))


def bucketed(left: DataFrame, right: DataFrame, spec: Spec, buckets: int | None = None) -> DataFrame:
    rows = timeline(left, right, spec)
    number = as_number(rows)
    buckets = buckets or how_many(rows.count())  # reads the keys and times alone, as the next line does
    cuts = rows.agg(F.percentile_approx(number, F.lit([i / buckets for i in range(1, buckets)]), F.lit(10 * buckets)).alias("c")).first()["c"]
    # one exchange, which both branches below read
    rows = rows.withColumn(BUCKET, bucket_of(number, sorted(set(cuts or [])))).repartition(*spec.keys, BUCKET)

    along = Window.partitionBy(*spec.keys, BUCKET).orderBy(*spec.order())
    filled = rows.withColumn("__m", F.last(R, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if spec.outer:
        filled = filled.withColumn("__next", F.lead(SIDE).over(along))

    right_only = F.col(SIDE) != 1
    place = F.struct(T, SIDE)
    if spec.backward:
        end = F.max_by(F.when(right_only, F.col(R)), F.when(right_only, F.struct(T, spec.tie)))
        first = F.min_by(SIDE, place)
    else:
        best = rows.filter(right_only).groupBy(*spec.keys, BUCKET, T).agg(F.max_by(R, F.struct(spec.tie)).alias("__best"))
        ends = best.groupBy(*spec.keys, BUCKET).agg(F.min_by("__best", T).alias("__end"))
        first = F.min_by(SIDE, F.struct((-as_number(rows)).alias("t"), SIDE))
    slots = rows.groupBy(*spec.keys, BUCKET).agg(first.alias("__first"), *([end.alias("__end")] if spec.backward else []))
    if not spec.backward:
        slots = slots.join(ends, [*spec.keys, BUCKET], "left")
    order = Window.partitionBy(*spec.keys).orderBy(F.col(BUCKET).asc() if spec.backward else F.col(BUCKET).desc())
    slots = slots.select(
        *spec.keys,
        BUCKET,
        F.last("__end", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"),
        F.lead("__first").over(order).alias("__after"),
    )
    both = filled.join(slots, [*spec.keys, BUCKET])
    return finished(both, left, spec, F.coalesce("__m", "__carry"), F.coalesce("__next", "__after") == 1 if spec.outer else None)
