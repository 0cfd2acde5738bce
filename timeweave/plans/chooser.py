"""Which strategy runs: by name, or by size.

``register`` adds a strategy of the caller's under a name of its own.

The cost formulas count comparisons: merging sorts both sides, the right probe
sorts the right side and searches it per left row, the left probe the reverse.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.plans.bucketed import bucketed
from timeweave.plans.fill import fill
from timeweave.plans.nested import nested
from timeweave.plans.probe import probe_left, probe_right

#: From these sizes on ``auto`` looks for hot keys, and considers the right probe.
HOT_BYTES, PROBE_BYTES = 1 << 32, 1 << 34
#: A key of so many rows is too large for one task.
HOT_ROWS = 5_000_000

#: Every accepted name: the physical plan and its options.  The upper-case names are
#: fixed values that users of this kind of join know.
NAMED = {
    "fill": ("fill", {}),
    "nested": ("nested", {}),
    "probe_right": ("probe_right", {}),
    "probe_left": ("probe_left", {}),
    "bucketed": ("bucketed", {}),
    "BASELINE": ("nested", {}),
    "SORTING NO PARTITIONING": ("fill", {}),
    "PARTITION SORTED MERGE": ("fill", {"semi": True}),
    "PARTITION RIGHT": ("probe_right", {}),
    "PARTITION LEFT": ("probe_left", {}),
    "PARTITION RIGHT BTREE": ("probe_right", {}),
    "PARTITION LEFT BTREE": ("probe_left", {}),
    "PARTITION BOTH + SORT LEFT": ("probe_left", {"by_key": True}),
    "PARTITION RIGHT + FILTER MIN": ("probe_right", {"static": True}),
    "PARTITION LEFT + FILTER MIN": ("probe_left", {"dynamic": True}),
    "PARTITION + COPY LEFT": ("probe_left", {}),
}


#: Every plan by its name.
PLANS = {"fill": fill, "nested": nested, "probe_left": probe_left, "probe_right": probe_right, "bucketed": bucketed}


def register(name: str, plan: Callable[..., DataFrame], **options) -> None:
    """Makes ``strategy=name`` run ``plan(left, right, spec, **options)``.

    ``plans/base.py`` says what a plan takes and gives.  With ``spec.outer`` it
    must add the right rows that no left row took, or hand over to ``fill``.
    """
    if name == "auto" or name in NAMED:
        raise ValueError(f"there is a strategy {name} already")
    PLANS[name] = plan
    NAMED[name] = (name, options)


def cost(left_rows: float, right_rows: float) -> dict[str, float]:
    """Comparisons of merge, right probe and left probe."""
    lg = lambda n: math.log2(n) if n > 1 else 0.0
    n, m = left_rows, right_rows
    return {"fill": n * lg(n) + m * lg(m) + n + m, "probe_right": m + m * lg(m) + n * lg(m), "probe_left": n + n * lg(n) + m * lg(n) + n}


def size_of_scans(df: DataFrame) -> tuple[int, bool]:
    """Bytes of the tables that ``df`` reads, and whether it can have no more rows than they.

    Catalyst's own estimate multiplies the sides of a join, so nothing is taken
    from above the scans; reads no data.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    total, grows, todo = 0, False, [plan]
    while todo:
        node = todo.pop()
        grows |= node.nodeName() in ("Join", "Generate", "Expand", "Union", "CartesianProduct")
        children = node.children()
        if children.isEmpty():
            total += int(str(node.stats().sizeInBytes()))
        todo += [children.apply(i) for i in range(children.size())]
    return total, not grows


def largest_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the most frequent key on both sides; reads the key columns alone and combines before it exchanges."""
    rows = left.select(*keys).unionByName(right.select(*keys))
    return rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def choose(left: DataFrame, right: DataFrame, keys: Sequence[str], bucketable: bool) -> str:
    """The plan for ``auto``.

    Without a key everything is one group, which only buckets spread; so is a key
    of ``HOT_ROWS`` rows or more, which is looked for where the inputs are large
    enough to hold one.  A right side under the session's broadcast threshold,
    against a left side large enough that not moving it pays for the Python
    workers, is probed in place, if the sizes of both are known: neither comes
    from a join.  Otherwise the sort stays inside the JVM and wins.
    """
    if not keys:
        return "bucketed" if bucketable else "fill"
    spark = left.sparkSession
    threshold = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    (a, a_known), (b, b_known) = size_of_scans(left), size_of_scans(right)
    if a_known and b_known and b <= threshold and a >= PROBE_BYTES:
        costs = cost(a, b)
        if costs["probe_right"] < costs["fill"]:
            return "probe_right"
    if bucketable and a + b >= HOT_BYTES and largest_key(left, right, keys) >= HOT_ROWS:
        return "bucketed"
    return "fill"
