"""Exact uniform shuffle into shards by a hypergeometric communication matrix.

The rows lie in logical partitions of at most about ``ROWS`` rows (a hash of the
row, so the result does not depend on how the input happens to be split into
files; rows alike in everything are numbered, so they are spread too).  The number
of rows that go from partition p to shard s is drawn exactly from the
multivariate hypergeometric law that a uniform shuffle has, with the shard
sizes fixed beforehand.  Then

1. each partition is permuted, and the first M[p, 0] of its rows go to shard 0,
   the next M[p, 1] to shard 1, and so on;
2. the rows are exchanged;
3. each shard is permuted again.  Its rows are split by the leading bits of a
   random key into ranges of at most about ``ROWS`` rows, whose counts give each
   range its first slot; so no task ever holds a whole shard.

The matrix has a number for each partition and shard, ``MOST_BOUNDS`` in all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeweave.llm.workspace import columns_of, local_table, occurrence, stored, table

#: Rows of a partition or range in the mean, and the least numbers of both.
ROWS, PARTS, CELLS = 250_000, 1024, 64
SEED = 20240229
MOST_SHARDS = 4096
#: So many bounds of 8 bytes are broadcast at most (34 MB); partitions grow beyond ROWS there.
MOST_BOUNDS = PARTS * MOST_SHARDS


def parts_and_cells(rows: int, shards: int) -> tuple[int, int]:
    """Numbers of partitions and, a power of two, of ranges of a shard."""
    parts = max(PARTS, min(-(-rows // ROWS), MOST_BOUNDS // shards))
    return parts, max(CELLS, 1 << (-(-rows // (shards * ROWS))).bit_length())


def communication_matrix(rows: np.ndarray, shards: np.ndarray, seed: int) -> np.ndarray:
    """Row p: how many rows of partition p go to each shard.

    ``rows`` and ``shards`` are the sizes of partitions and shards, with equal
    sums.  Each row is a multivariate hypergeometric draw from what the shards
    still lack, so the whole is distributed as under a uniform random shuffle.
    """
    rng = np.random.default_rng(seed)
    left = np.asarray(shards, dtype=np.int64).copy()
    out = np.zeros((len(rows), len(left)), dtype=np.int64)
    for p, n in enumerate(rows):
        rest, need = int(n), int(left.sum())
        for s in range(len(left)):  # conditional univariate draws have no limit on the population
            if rest == 0:
                break
            need -= int(left[s])
            out[p, s] = rest if need == 0 else draw(rng, int(left[s]), need, rest)
            rest -= int(out[p, s])
        left -= out[p]
    return out


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw.  numpy takes populations of under 1e9; beyond, the
    mass function is inverted over the mode and 12 standard deviations around it."""
    if max(good, bad, n) < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    share = good / total
    spread = int(12 * (n * share * (1 - share) * (total - n) / max(1, total - 1)) ** 0.5) + 12
    mode = (n + 1) * (good + 1) // (total + 2)
    low, high = max(0, n - bad, mode - spread), min(n, good, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    mass = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.exp(mass - mass.max()).cumsum()
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def shard_rows(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Shards differ by one row at most; slots run from 0 without gaps; equal input
    gives the equal result however it is partitioned.  Size: UTF-8 bytes plus 1.
    A null text has no bytes, a null id is an id of its own, rows alike in id and
    text are spread like any other, an empty table gives no rows, and other
    columns are ignored.  ``law`` is ``rows``; ``grown_shard`` is null.
    """
    if not 1 <= n_shards <= MOST_SHARDS:
        raise ValueError(f"n_shards must lie in 1..{MOST_SHARDS}")
    spark = docs.sparkSession
    rows = columns_of(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    slim = stored(
        rows.select(
            "doc_id",
            (F.octet_length("text") + 1).cast("long").alias("size"),
            F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
            F.xxhash64("text").alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    n_parts, n_cells = parts_and_cells(slim.count(), n_shards)
    # rows are told apart by what they hold and, if that is alike, by a number
    ties = ["doc_id", "size", "text_crc32", "digest", "nth"]
    slim = occurrence(slim, ties[:-1], "row", "nth").select(*ties)
    key = lambda k: F.xxhash64(F.lit(seed), F.lit(k), *ties)
    slim = stored(slim.withColumn("part", F.pmod(key(0), F.lit(n_parts)).cast("int")), "shard-parts")

    counts = {r["part"]: r["count"] for r in slim.groupBy("part").count().collect()}  # a row per partition
    total = sum(counts.values())
    sizes = np.full(n_shards, total // n_shards, dtype=np.int64)
    sizes[: total % n_shards] += 1
    parts = sorted(counts)
    matrix = communication_matrix(np.array([counts[p] for p in parts], dtype=np.int64), sizes, seed)
    ends = matrix.cumsum(axis=1)
    bounds = local_table(spark, part=(pa.int32(), parts), ends=(pa.list_(pa.int64()), ends.tolist()))

    first = Window.partitionBy("part").orderBy(key(1), *ties)
    sent = stored(
        slim.withColumn("rank", F.row_number().over(first))
        .join(F.broadcast(bounds), "part")
        .select(*ties, F.size(F.filter("ends", lambda e: e < F.col("rank"))).alias("shard"), key(2).alias("key")),
        "shard-sent",
    ).withColumn("cell", F.shiftrightunsigned("key", 64 - n_cells.bit_length() + 1).cast("int"))

    cells = sent.groupBy("shard", "cell").count()  # n_shards x n_cells rows
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    second = Window.partitionBy("shard", "cell").orderBy("key", *ties)
    return (
        sent.withColumn("at", F.row_number().over(second) - 1)
        .join(cells, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return shard_rows(table(spark, folder, "documents"))
