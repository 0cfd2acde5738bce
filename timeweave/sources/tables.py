"""Readers of price and order files: three columns, by position, header optional."""

from __future__ import annotations

import atexit
import functools
import logging
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

PRICES = StructType([StructField("time", LongType()), StructField("stock", StringType()), StructField("price", LongType())])
ORDERS = StructType([StructField("time", LongType()), StructField("stock", StringType()), StructField("amount", LongType())])
log = logging.getLogger(__name__)


def _read(spark: SparkSession, path: str, schema: StructType, delimiter: str, shuffle: bool, seed: int) -> DataFrame:
    """A line that begins with ``time`` is a header wherever a file has it, so files with and without one mix."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("time") & (F.trim("value") != ""))
    parsed = F.from_csv("value", F.lit(schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")), {"sep": delimiter, "mode": "FAILFAST", "quote": ""})
    df = lines.select(parsed.alias("row")).select("row.*")
    return df.orderBy(F.rand(seed)) if shuffle else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; on a local master any folder is."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{_own_folder()}"
    return f"{folder.rstrip('/')}/timeweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="timeweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def load_prices(spark: SparkSession, path: str, delimiter: str = ",", shuffle: bool = False, seed: int = 0) -> DataFrame:
    """``time, stock, price``; a row that doesn't parse raises an error when read."""
    return _read(spark, path, PRICES, delimiter, shuffle, seed)


def load_order_book(spark: SparkSession, path: str, delimiter: str = ",", shuffle: bool = False, seed: int = 0) -> DataFrame:
    """``time, stock, amount``; a row that doesn't parse raises an error when read."""
    return _read(spark, path, ORDERS, delimiter, shuffle, seed)


def load_data(spark: SparkSession, prices: str, orders: str, delimiter: str = ",", shuffle: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both tables."""
    began = time.perf_counter()
    out = load_prices(spark, prices, delimiter, shuffle), load_order_book(spark, orders, delimiter, shuffle)
    log.info("planned the scans of %s and %s in %.3f s", prices, orders, time.perf_counter() - began)
    return out


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """A result as Parquet, CSV (with header), JSON or ORC."""
    writer = df.write.mode(mode)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
