"""The as-of join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from timeweave.plans.base import LOST, R, T, TIE, Spec
from timeweave.plans.bucketed import BUCKETABLE
from timeweave.plans.chooser import NAMED, PLANS, choose
from timeweave.plans.filters import dynamic_bound, keys_of_other, static_bound



def _column(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"]


HOWS = ("inner", "left", "right", "full", "semi", "anti")
COMPARISONS = {"<=": ("backward", True), "<": ("backward", False), ">=": ("forward", True), ">": ("forward", False)}


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str = (),
    left_time: str = "time",
    right_time: str = "time",
    direction: str = "backward",
    allow_exact: bool = True,
    how: str = "inner",
    tie_break: Sequence[str] | None = None,
    strategy: str = "auto",
    suffix: str = "_right",
    static_filter: bool = False,
    dynamic_filter: bool = False,
) -> DataFrame:
    """For each left row the nearest right row of the same key.

    ``backward`` takes the latest right row at or before the left time (before
    it, without ``allow_exact``), ``forward`` the earliest at or after;
    ``equal`` asks for the same time.  Of right rows alike in key and time the
    greatest by ``tie_break`` wins (default: all payload columns in order; null
    is smallest).  A null key or time matches nothing; a NaN key matches NaN.

    The result has the left columns, then the right ones without the keys; a
    right column of a taken name gets ``suffix``.  ``right`` and ``full`` also
    give the right rows that no left row took; their keys come from there, and
    the timeline of ``fill`` or ``bucketed`` finds them in the same pass,
    whatever the strategy.
    ``semi`` and ``anti`` give left columns alone.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in HOWS:
        raise ValueError(f"how must be one of {HOWS}")
    if direction not in ("backward", "forward", "equal"):
        raise ValueError("direction must be backward, forward or equal")
    if strategy != "auto" and strategy not in NAMED:
        raise ValueError(f"strategy must be auto or one of {sorted(NAMED)}")
    if direction == "equal":
        return asof_join(left, right, [*keys, left_time], left_time, right_time, "backward", True, how, tie_break, strategy, suffix) if left_time == right_time else _equal(left, right, keys, left_time, right_time, how, tie_break, strategy, suffix)

    shown = [c for c in right.columns if c not in keys]
    payload = [c for c in shown if c != right_time]
    atomic = lambda c: isinstance(right.schema[c].dataType, AtomicType)
    ties = list(tie_break) if tie_break is not None else [c for c in payload if atomic(c)]
    # the shown columns, time first, are in the default order of ties already
    itself = tie_break is None and len(ties) == len(payload) and atomic(right_time)
    spec = Spec(tuple(f"__k{i}" for i in range(len(keys))), direction == "backward", allow_exact, R if itself else TIE, how in ("right", "full"))

    def valid(df, time):
        out = F.lit(True)
        for c in (*keys, time):
            out = out & _column(df, c).isNotNull()
        return out

    def prepared(df, time):
        return [*[_column(df, c).alias(k) for k, c in zip(spec.keys, keys, strict=True)], _column(df, time).alias(T)]

    def row(df):
        return F.struct(*[_column(df, c).alias(f"f{i}") for i, c in enumerate([right_time, *payload])]) if right_time in shown else F.struct(*[_column(df, c).alias(f"f{i}") for i, c in enumerate(payload)], F.lit(1).alias("one"))

    field = {c: f"f{i}" for i, c in enumerate([right_time, *payload] if right_time in shown else payload)}
    a_ok, b_ok = valid(left, left_time), valid(right, right_time)
    own = [f"__l{i}" for i in range(len(left.columns))]
    a = left.filter(a_ok).select(*[_column(left, c).alias(o) for o, c in zip(own, left.columns, strict=True)], *prepared(left, left_time))
    tie = [] if itself else [(F.struct(*[_column(right, c).alias(f"f{i}") for i, c in enumerate(ties)]) if ties else F.struct(F.lit(0).alias("none"))).alias(TIE)]
    b = right.filter(b_ok).select(*prepared(right, right_time), *tie, row(right).alias(R))

    name = choose(a, b, spec.keys, isinstance(left.schema[left_time].dataType, BUCKETABLE)) if strategy == "auto" else strategy
    plan, options = NAMED[name]
    options = dict(options)
    probe, reach = a, b
    if options.pop("semi", False) and how in ("inner", "semi"):
        probe = keys_of_other(probe, b, spec)
    if (options.pop("static", False) or static_filter) and how in ("inner", "semi", "right"):
        probe = static_bound(probe, b, spec)
    if (options.pop("dynamic", False) or dynamic_filter) and not spec.outer:
        reach = dynamic_bound(probe, b, spec)
    matched = PLANS[plan](probe, reach, spec, **options)

    found = F.col(R).isNotNull()
    back = [F.col(o).alias(c) for o, c in zip(own, left.columns, strict=True)]
    lost = left.filter(~F.coalesce(a_ok, F.lit(False)))
    if how == "semi":
        return matched.filter(found).select(*back)
    if how == "anti":
        return matched.filter(~found).select(*back).unionByName(lost)
    renamed = {c: c + suffix if c in left.columns else c for c in shown}
    if spec.outer:  # a right row of no left row has the keys alone of the left columns
        of_key = dict(zip(keys, spec.keys, strict=True))
        back = [F.when(F.col(LOST), F.col(of_key[c]).cast(left.schema[c].dataType)).otherwise(F.col(o)).alias(c) if c in of_key else F.col(o).alias(c) for o, c in zip(own, left.columns, strict=True)]
    out = matched.filter(found) if how in ("inner", "right") else matched
    result = out.select(*back, *[F.col(f"{R}.{field[c]}").alias(renamed[c]) for c in shown])
    empty = [F.lit(None).cast(right.schema[c].dataType).alias(renamed[c]) for c in shown]
    if how in ("left", "full"):
        result = result.unionByName(lost.select(*[_column(lost, c) for c in left.columns], *empty))
    if spec.outer:
        rest = right.filter(~F.coalesce(b_ok, F.lit(False)))
        filled = [_column(rest, c).cast(left.schema[c].dataType).alias(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns]
        result = result.unionByName(rest.select(*filled, *[_column(rest, c).alias(renamed[c]) for c in shown]))
    return result


def _equal(left, right, keys, left_time, right_time, how, tie_break, strategy, suffix) -> DataFrame:
    """Equal times under two names: the time is one more key, and shown again."""
    ties = tie_break if tie_break is not None else [c for c in right.columns if c not in keys and c != right_time and isinstance(right.schema[c].dataType, AtomicType)]
    b = right.withColumn("__right_time", right[right_time]).withColumnRenamed(right_time, left_time)
    b = b.withColumn("__eq", F.col("__right_time"))
    a = left.withColumn("__eq", left[left_time])
    out = asof_join(a, b, [*keys, left_time], "__eq", "__eq", "backward", True, how, ties, strategy, suffix)
    name = right_time + suffix if right_time in left.columns else right_time
    drop = ["__eq", f"__eq{suffix}"]
    return out.drop(*drop).withColumnRenamed("__right_time", name) if how not in ("semi", "anti") else out.drop(*drop)


