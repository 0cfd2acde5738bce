"""Connected components over an edge table, in Spark.

Alternates the large-star and small-star steps of Kiveris et al. (2014): every
node links its larger neighbours, then its smaller ones, to the smallest node it
knows.  Both steps keep the components, and the edges end as a star around each
component's smallest node.  A hub is a long row group of one aggregation, which
combines on the map side; neighbour lists are never built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.workspace import stored

MOST_ROUNDS = 60


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    hung = both.join(least, "a")
    out = hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a, b``: every node that is not its component's smallest, and that smallest node.

    ``edges(a, b)`` holds comparable ids in any order; loops and repeated edges
    don't matter, null ends are dropped, no edges give no rows.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        new = stored(_star(_star(now, larger=True), larger=False), "edges")
        # a star forest has no node that is both an end and a centre, and no end with two centres
        centres = new.select(F.col("b").alias("a")).distinct()
        chained = not new.join(centres, "a", "left_semi").isEmpty()
        if not chained and new.groupBy("a").count().filter("count > 1").isEmpty():
            return new
        now = new
    raise RuntimeError("components did not settle")
