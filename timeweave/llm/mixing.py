"""Mixing sources to target weights by entropy balancing.

Among all document rates r in [0, 2] that give every source its target number
of words, entropy balancing takes those of the least relative entropy against
"every document once".  The dual is convex with one multiplier per source, and
its solution tilts exponentially in the document's size x:

    r = min(2, exp(lambda_source * x / mean size of the source))

The dual's gradient and curvature are sums over documents, which Spark computes
from the (source, size) histogram in every Newton step; a bracket around each
multiplier makes the steps safe.  The rates depend on source and size alone, so
rounding works on the histogram as well: going through a source's sizes from
large to small, each cell gets its exact copies rounded down or up, whichever
brings the words taken so far nearer to what the rates ask.  Within a cell the documents with
the smallest hashes take the odd copies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeweave.llm.workspace import columns_of, local_table, occurrence, stored, table, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST_COPIES = 1.5, 2
STEPS, TOLERANCE = 100, 1e-9
#: A dual that is farther than this from a target after all steps is an error.
CONVERGED = 1e-6
#: The multipliers of the sources are held by the driver; sources are a short configured list.
MOST_SOURCES = 100_000
#: Cells with more documents than 1 / HOT of all are ranked in parts of ROWS documents
#: in the mean, SUBCELLS of them at least; there are HOT such cells at most.
HOT, SUBCELLS, ROWS = 1000, 64, 250_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, cap: float = MOST_COPIES) -> list[float]:
    """Targets in proportion to the weights, none above ``cap`` times its size.

    What a source can't take is shared again by weight among those still below.
    """
    goal, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        rest = goal - math.fsum(out[i] for i in range(len(sizes)) if i not in set(open_))
        weight = math.fsum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / weight
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        open_ = [i for i in open_ if i not in set(over)]
    return out


def solve_dual(cells: DataFrame, sources: list[tuple[int, int, int, float]], cap: float = MOST_COPIES) -> dict[int, float]:
    """Multipliers by source number; ``cells(s, size, n)``, sources as (s, documents, words, target).

    A target of 0 gives minus infinity, one of ``cap`` times the words infinity.
    """
    spark = cells.sparkSession
    scale = {s: words / max(1, n) for s, n, words, _ in sources}
    goal = {s: t for s, _, _, t in sources}
    tilt: dict[int, float] = {}
    low: dict[int, float] = {}
    high: dict[int, float] = {}
    for s, _, words, t in sources:
        if t <= 0 or t >= cap * words * (1 - 1e-12):
            tilt[s] = -math.inf if t <= 0 else math.inf
        else:
            tilt[s] = 0.0
    active = [s for s in tilt if math.isfinite(tilt[s])]
    for _ in range(STEPS):
        if not active:
            break
        now = local_table(spark, s=(pa.int32(), active), tilt=(pa.float64(), [tilt[s] for s in active]), scale=(pa.float64(), [scale[s] for s in active]))
        x = F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), F.col("tilt") * x)))
        words = F.col("n") * F.col("size")
        sums = (
            cells.join(F.broadcast(now), "s")
            .select("s", (words * rate).alias("taken"), (words * x * F.when(rate < cap, rate).otherwise(0.0)).alias("slope"))
            .groupBy("s")
            .agg(F.sum("taken").alias("taken"), F.sum("slope").alias("slope"))
            .collect()  # one row per source
        )
        still, gaps = [], []
        for r in sums:
            s, gap = r["s"], r["taken"] - goal[r["s"]]
            if abs(gap) <= TOLERANCE * goal[s]:
                continue
            (high if gap > 0 else low)[s] = tilt[s]
            a, b = low.get(s, -math.inf), high.get(s, math.inf)
            new = tilt[s] - gap / r["slope"] if r["slope"] > 0 else math.nan
            if not a < new < b:  # outside the bracket, or no slope: halve it, or double the way out
                new = (a + b) / 2 if math.isfinite(a) and math.isfinite(b) else (2 * a + 1 if gap < 0 else 2 * b - 1)
            if new != tilt[s]:
                tilt[s] = new
                still.append(s)
                gaps.append(abs(gap) / goal[s])
        active = still
    if active and max(gaps) > CONVERGED:
        raise RuntimeError(f"the dual has not converged in {STEPS} steps: a source is {max(gaps):.2g} of its target away")
    return tilt


def rounded(cells: pd.DataFrame, cap: int = MOST_COPIES) -> pd.DataFrame:
    """Copies for the cells of one source, whose ``rate`` is given: at most one cell per size."""
    cells = cells.sort_values("size", ascending=False, kind="stable")
    carry, copies = 0.0, []
    for size, n, rate in zip(cells["size"], cells["n"], cells["rate"], strict=True):
        want = n * rate + (carry / size if size else 0.0)
        k = min(max(math.floor(want + 0.5), math.floor(n * rate)), min(math.ceil(n * rate), cap * n))
        carry = size * (want - k) if size else carry
        copies.append(int(k))
    return cells.assign(copies=copies)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, rate, copies, taken, row``.

    ``taken`` is ``copies`` (0, 1 or 2) times ``size``.  Sources take the weights
    in code-point order, a null source comes last and is a source of its own.  A
    null text has size 0 and 1 copy where its source's rates are not pushed to
    the bound; a source of no words has target 0.  A null id counts like any
    other; rows alike in id, source and size are interchangeable, and spread over
    tasks like any other.  ``row``
    is the unique number in ``row_col``, or one given here.  An empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = columns_of(docs, doc_id=id_col, text=text_col, source=source_col, **({"number": row_col} if row_col else {}))
    number = F.col("number") if row_col else F.monotonically_increasing_id()
    slim = stored(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), number.alias("row")), "mix-rows")
    totals = slim.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goals = targets([r["words"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], share)
    names, sizes = [r["source"] for r in totals], [r["words"] for r in totals]
    named = local_table(spark, s=(pa.int32(), range(len(totals))), source=(pa.string(), names), source_size=(pa.int64(), sizes), target=(pa.float64(), goals))
    slim = slim.join(F.broadcast(named.select("s", F.col("source").alias("source_"))), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")

    cells = stored(slim.groupBy("s", "size").agg(F.count("*").alias("n")), "mix-cells")
    tilt = solve_dual(cells, [(i, r["n"], r["words"], goals[i]) for i, r in enumerate(totals)])
    scale = [r["words"] / max(1, r["n"]) for r in totals]

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        s = int(frame["s"].iloc[0])
        bound = {-math.inf: 0.0, math.inf: float(MOST_COPIES)}.get(tilt[s])
        exponent = (lambda z: min(50.0, tilt[s] * z / scale[s])) if scale[s] else (lambda z: 0.0)
        frame["rate"] = [bound if bound is not None else min(float(MOST_COPIES), math.exp(exponent(z))) for z in frame["size"]]
        return rounded(frame)[["s", "size", "n", "rate", "copies"]]

    plan = stored(cells.groupBy("s").applyInPandas(settle, "s int, size long, n long, rate double, copies long"), "mix-plan")

    # rank documents by hash within their cell; large cells are ranked in parts
    every = sum(r["n"] for r in totals)
    large = plan.filter(F.col("n") * HOT > every).select("s", "size", F.greatest(F.lit(SUBCELLS), F.ceil(F.col("n") / ROWS)).alias("parts"))
    # rows alike are told apart by a number, so that their hashes differ
    slim = occurrence(slim, ["doc_id", "s", "size"], "row", "nth").withColumn("hash", F.xxhash64(F.lit(7), "doc_id", "size", "nth")).drop("nth")
    dealt = slim.join(F.broadcast(large), ["s", "size"], "left").withColumn("part", F.pmod("hash", F.coalesce("parts", F.lit(1)))).drop("parts")
    sub = dealt.groupBy("s", "size", "part").agg(F.count("*").alias("m"))
    before = Window.partitionBy("s", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sub = sub.withColumn("first", F.coalesce(F.sum("m").over(before), F.lit(0))).join(plan, ["s", "size"])
    at = F.row_number().over(Window.partitionBy("s", "size", "part").orderBy("hash", "doc_id", "row")) + F.col("first") - 1
    copies = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("at") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return (
        dealt.join(sub.drop("m"), ["s", "size", "part"])
        .withColumn("at", at)
        .withColumn("copies", copies.cast("long"))
        .join(F.broadcast(named.drop("source")), "s")
        .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "row")
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
