"""Sort and fill: one exchange on the keys, one sort, one running ``last``.

The rows of both tables form one timeline per key, and each left row takes the
last right row before it.  Cost is that of a sort; no row is compared with
another.  A right row is taken exactly if a left row comes next, so the rows
that ``right`` and ``full`` add are known in the same pass.  One key is one
task, see ``bucketed`` for keys too large for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeweave.plans.base import R, SIDE, Spec, finished, timeline


def fill(left: DataFrame, right: DataFrame, spec: Spec) -> DataFrame:
    along = spec.window(*spec.order())
    running = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = timeline(left, right, spec).withColumn("__m", F.last(R, ignorenulls=True).over(running))
    if spec.outer:
        rows = rows.withColumn("__next", F.lead(SIDE).over(along))
    return finished(rows, left, spec, F.col("__m"), F.col("__next") == 1 if spec.outer else None)
