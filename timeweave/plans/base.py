"""What every strategy takes and gives.

A strategy gets two prepared tables and adds to each left row the struct
``__r`` of its match, or null:

* left: columns ``__l0, __l1, ...``, keys ``__k0, __k1, ...`` and time ``__t``;
* right: keys and time likewise, ``__r`` (the columns to show as one struct, so
  that null payloads travel with it) and, where ``__r`` doesn't order rows of
  equal time by itself, ``__tie`` (a struct that does; the greatest wins).

The caller's names never meet these.  Keys and times are never null here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

T, TIE, R, SIDE = "__t", "__tie", "__r", "__side"
#: With ``outer`` set, a right row that no left row took comes back too, marked so.
LOST = "__lost"


@dataclass(frozen=True)
class Spec:
    keys: tuple[str, ...]
    backward: bool = True
    exact: bool = True
    tie: str = TIE
    outer: bool = False

    def time(self) -> Column:
        """Ascending in the direction of the search."""
        return F.col(T).asc() if self.backward else F.col(T).desc()

    def right_side(self) -> int:
        """Right rows come before left rows of the same time exactly if they may match them."""
        return 0 if self.exact else 2

    def order(self) -> list[Column]:
        """Along the timeline; of right rows alike in key and time the greatest comes last."""
        return [self.time(), F.col(SIDE).asc(), F.col(self.tie).asc_nulls_first()]

    def latest(self) -> Column:
        """Of right rows, the one that is last in time and greatest."""
        return F.max_by(R, F.struct(T, self.tie))

    def window(self, *order: Column) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*order)


def timeline(left: DataFrame, right: DataFrame, spec: Spec) -> DataFrame:
    """Both tables as one; a left row has side 1, a right row 0 or 2."""
    ties = [spec.tie] if spec.tie != R else []
    rows = right.select(*spec.keys, T, *ties, R).withColumn(SIDE, F.lit(spec.right_side()))
    return left.withColumn(SIDE, F.lit(1)).unionByName(rows, allowMissingColumns=True)


def finished(rows: DataFrame, left: DataFrame, spec: Spec, match: Column, taken: Column | None = None) -> DataFrame:
    """Left rows of a timeline with their ``match``; with ``outer`` also right rows not ``taken``."""
    if not spec.outer:
        return rows.filter(F.col(SIDE) == 1).select(*left.columns, match.alias(R))
    mine = F.col(SIDE) == 1
    rows = rows.filter(mine | ~F.coalesce(taken, F.lit(False)))
    return rows.select(*left.columns, F.when(mine, match).otherwise(F.col(R)).alias(R), (~mine).alias(LOST))
