"""Index one side, probe with the other.

``probe_right`` broadcasts the sorted right side and searches it for every left
row.  ``probe_left`` broadcasts the sorted times of the left side, credits each
right row to the first left time that can see it, keeps the best per left time
(an aggregation that combines on the map side), and fills the gaps.

Either broadcast is made only if the side has at most ``limit`` rows and
``LIMIT_BYTES`` bytes, measured beforehand; beyond, ``probe_right`` falls back on
the fill plan and ``probe_left`` finds the left time by a window.  The index is
built once, on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, DoubleType, FloatType, StringType, StructField, StructType

from timeweave.functions.search import search
from timeweave.plans.base import R, SIDE, T, TIE, Spec
from timeweave.plans.fill import fill

LIMIT, LIMIT_BYTES = 1_000_000, 256 << 20


def _width(df: DataFrame) -> Column:
    """Bytes of a row: 8 for a plain value, its length for a text, that of its JSON for the rest."""
    out = F.lit(0)
    for f in df.schema.fields:
        kind, c = f.dataType, F.col(f"`{f.name}`")
        wide = F.octet_length(c) if isinstance(kind, StringType | BinaryType) else F.lit(8) if isinstance(kind, AtomicType) else F.octet_length(F.to_json(F.struct(c)))
        out = out + F.coalesce(wide, F.lit(0)) + 8
    return out.cast("long")


def _fits(df: DataFrame, limit: int) -> bool:
    n, size = df.select(_width(df).alias("w")).limit(limit + 1).agg(F.count("*"), F.sum("w")).first()
    return n <= limit and (size or 0) <= LIMIT_BYTES


def _plain_keys(left: DataFrame, right: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame, Spec]:
    """Fractional keys as texts, in which NaN equals itself and -0 equals 0, as Spark has it."""
    names = []
    for k in spec.keys:
        kinds = (left.schema[k].dataType, right.schema[k].dataType)
        if any(isinstance(kind, DoubleType | FloatType) for kind in kinds):
            text = (F.col(k).cast("double") + F.lit(0.0)).cast("string")
            left, right = left.withColumn(f"{k}_text", text), right.withColumn(f"{k}_text", text)
            names.append(f"{k}_text")
        else:
            names.append(k)
    return left, right, replace(spec, keys=tuple(names))


@dataclass
class Index:
    """Row range of each key in a table sorted by key and time, the times, and what is looked up."""

    ranges: dict
    times: np.ndarray
    values: pa.Array

    @classmethod
    def of(cls, table: pa.Table, keys: tuple[str, ...], column: str) -> Index:
        values = table.column(column).combine_chunks()
        times = table.column(T).to_pandas().to_numpy()
        if not keys or not table.num_rows:
            return cls({} if keys else {(): (0, table.num_rows)}, times, values)
        frame = table.select(list(keys)).to_pandas()
        change = np.flatnonzero((frame != frame.shift()).any(axis=1).to_numpy())
        ends = np.append(change[1:], len(frame))
        return cls({tuple(k): (int(a), int(b)) for k, a, b in zip(frame.iloc[change].itertuples(index=False, name=None), change, ends, strict=True)}, times, values)

    def find(self, batch: pa.RecordBatch, keys: tuple[str, ...], backward: bool, exact: bool) -> pa.Array:
        """For each row of the batch the value at the nearest time of its key, else null."""
        wanted = pa.Table.from_batches([batch.select([T])]).to_pandas()[T].to_numpy()
        at = np.full(batch.num_rows, -1, dtype=np.int64)
        for key, rows in _groups(batch, keys):
            a, b = self.ranges.get(key, (0, 0))
            found = search(self.times[a:b], wanted[rows], backward, exact)
            at[rows] = np.where(found >= 0, found + a, -1)
        return self.values.take(pa.array(at, mask=at < 0))


def _groups(batch: pa.RecordBatch, keys: tuple[str, ...]) -> Iterator[tuple[tuple, np.ndarray]]:
    if not keys:
        yield (), np.arange(batch.num_rows)
        return
    frame = pa.Table.from_batches([batch.select(list(keys))]).to_pandas()
    for k, rows in frame.groupby(list(keys), sort=False).indices.items():
        yield (k if isinstance(k, tuple) else (k,)), rows


def probe_right(left: DataFrame, right: DataFrame, spec: Spec, limit: int = LIMIT) -> DataFrame:
    if spec.outer or not _fits(right, limit):
        return fill(left, right, spec)
    probe, feed, named = _plain_keys(left, right, spec)
    # among equal times the greatest tie is the last for <= and must be the first for >=
    tie = F.col(spec.tie).asc_nulls_first() if spec.backward else F.col(spec.tie).desc_nulls_last()
    table = feed.orderBy(*named.keys, T, tie).select(*named.keys, T, R).toArrow()
    shared = left.sparkSession.sparkContext.broadcast(Index.of(table, named.keys, R))
    schema = StructType([*probe.schema.fields, StructField(R, right.schema[R].dataType, True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            match = shared.value.find(batch, named.keys, spec.backward, spec.exact)
            yield pa.RecordBatch.from_arrays([*batch.columns, match], [*batch.schema.names, R])

    return probe.mapInArrow(run, schema).select(*left.columns, R)


def probe_left(left: DataFrame, right: DataFrame, spec: Spec, limit: int = LIMIT, by_key: bool = False) -> DataFrame:
    if spec.outer:
        return fill(left, right, spec)
    times = left.select(*spec.keys, T).distinct()
    if by_key:  # cluster the probing side by key, so that its cache lines meet one key's index
        right = right.repartition(*spec.keys) if spec.keys else right
    credited = _credit_by_search(times, right, spec) if _fits(times, limit) else _credit_by_window(times, right, spec)
    # of the rows at the nearest time the greatest tie wins; both ways combine before they exchange
    if spec.backward:
        chosen = credited.groupBy(*spec.keys, "__to").agg(spec.latest().alias(R))
    else:
        chosen = credited.groupBy(*spec.keys, "__to", T).agg(F.max_by(R, F.struct(spec.tie)).alias(R)).groupBy(*spec.keys, "__to").agg(F.min_by(R, T).alias(R))
    # one row for each key and time: nothing is left to break a tie with
    chosen = chosen.select(*spec.keys, F.col("__to").alias(T), F.lit(0).alias(TIE), R)
    return fill(left, chosen, Spec(spec.keys, spec.backward, True))


def _credit_by_search(times: DataFrame, right: DataFrame, spec: Spec) -> DataFrame:
    targets, feed, named = _plain_keys(times, right, spec)
    table = targets.orderBy(*named.keys, T).select(*named.keys, T).toArrow()
    shared = right.sparkSession.sparkContext.broadcast(Index.of(table, named.keys, T))
    schema = StructType([*feed.schema.fields, StructField("__to", times.schema[T].dataType, True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = shared.value.find(batch, named.keys, not spec.backward, spec.exact)
            yield pa.RecordBatch.from_arrays([*batch.columns, to], [*batch.schema.names, "__to"])

    return feed.mapInArrow(run, schema).filter("__to IS NOT NULL")


def _credit_by_window(times: DataFrame, right: DataFrame, spec: Spec) -> DataFrame:
    """The nearest left time on the other side of each right row, by a fill in the other direction."""
    back = spec.window(F.col(T).desc() if spec.backward else F.col(T).asc(), F.col(SIDE).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = right.withColumn(SIDE, F.lit(spec.right_side())).unionByName(times.withColumn(SIDE, F.lit(1)), allowMissingColumns=True)
    rows = rows.withColumn("__to", F.last(F.when(F.col(SIDE) == 1, F.col(T)), ignorenulls=True).over(back))
    return rows.filter((F.col(SIDE) != 1) & F.col("__to").isNotNull()).drop(SIDE)
