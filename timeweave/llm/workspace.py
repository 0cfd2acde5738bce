"""Shared-folder tables that cut lineage, and small helpers all operators use.

Everything that must outlive an executor goes to the folder the cluster names
in ``spark.checkpoint.dir``.  Only on a local master, where driver and executors
are one process, a private temporary folder stands in for it; elsewhere its
absence is an error.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every contract here: ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (master {master})")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="timeweave-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store that executors open with Arrow, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/timeweave-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes what this session's operators have stored; their results can't be read after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    The plan above it starts from files, so a lost executor costs a re-read and
    never a recomputation, and columns such as row numbers can't change between
    two uses.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """``row, doc``, stored: a number for each row, and all its columns as one struct.

    So no column of the caller's meets an inner name; ``select("doc.*")`` gives
    them back.  A scan reads only the fields that are asked for.
    """
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "numbered")


def local_table(spark: SparkSession, **columns: tuple[pa.DataType, Iterable]) -> DataFrame:
    """A small table of the driver's; goes through Arrow, so executors run no Python for it."""
    return spark.createDataFrame(pa.table({name: pa.array(list(values), kind) for name, (kind, values) in columns.items()}))


def release() -> None:
    """Gives a Python worker's freed memory back, as it idles beside the next stage's work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library that does so by itself
        pass


def batches(it: Iterator[pa.RecordBatch], most: int = 16 << 20, tidy: bool = True) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes, one row at least; ``tidy`` frees memory in between."""
    for batch in it:
        n = max(1, min(batch.num_rows, int(batch.num_rows * most / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)
        if tidy:
            release()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives back what its last batch took."""

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)
        release()

    return whole


def columns_of(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named input columns, under the operator's own names.

    Further columns of the input, whatever their names, take no part.
    """
    return df.select(*[df[name].alias(alias) for alias, name in wanted.items()])


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def without_blanks(c: Column) -> Column:
    return F.translate(c, BLANKS, "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def occurrence(df: DataFrame, alike: Sequence[str], row: str, name: str) -> DataFrame:
    """With ``name``: 0, 1, ... among the rows equal in the columns ``alike``, nulls too.

    ``row`` is a stored number whose upper bits are a partition, as
    ``monotonically_increasing_id`` gives it.  A group of equal rows is numbered
    partition by partition, so no task holds more than a partition of it.
    """
    d = df.withColumn("__alike", F.xxhash64(*alike)).withColumn("__part", F.shiftright(row, 33))
    before = Window.partitionBy("__alike").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy("__alike", "__part").agg(F.count(F.lit(1)).alias("__n"))
    first = parts.select("__alike", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    at = F.row_number().over(Window.partitionBy("__alike", "__part").orderBy(row)) - 1
    return d.withColumn("__at", at).join(first, ["__alike", "__part"]).withColumn(name, F.col("__first") + F.col("__at")).drop("__alike", "__part", "__at", "__first")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
