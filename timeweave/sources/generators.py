"""Seeded generators of prices and orders; the same seed and partitions give the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(low: int, high: int, seed: int) -> Column:
    """Whole numbers from low to high, both included."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("long")


def _stock(number: Column, prefix: str = "s-") -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def regular_prices(spark: SparkSession, n: int, rate: int, stocks: int, seed: int = 0) -> DataFrame:
    """A price every ``rate`` ticks, of a random stock s-0 to s-``stocks``; price 0 to 100."""
    return spark.range(n).select((F.col("id") * rate).alias("time"), _stock(_uniform(0, stocks, seed)).alias("stock"), _uniform(0, 100, seed + 1).alias("price"))


def uniform_prices(spark: SparkSession, n: int, max_time: int, stocks: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select(_uniform(0, max_time, seed).alias("time"), _stock(_uniform(0, stocks, seed + 1)).alias("stock"), _uniform(0, 100, seed + 2).alias("price"))


def uniform_orders(spark: SparkSession, n: int, max_time: int, stocks: int, min_time: int = 0, seed: int = 0) -> DataFrame:
    """Orders from ``min_time`` on, as for a percentile of the feed."""
    return spark.range(n).select(_uniform(min_time, max_time, seed).alias("time"), _stock(_uniform(0, stocks, seed + 1)).alias("stock"), _uniform(0, 100, seed + 2).alias("amount"))


def zipf(spark: SparkSession, stocks: int, skew: float) -> DataFrame:
    """``rank`` 1 to ``stocks``, with the upper end of its share on [0, 1)."""
    from pyspark.sql import Window

    weight = F.pow(F.col("id").cast("double"), -float(skew))
    ranks = spark.range(1, stocks + 1).select(F.col("id").alias("rank"), weight.alias("w"))
    so_far = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = ranks.agg(F.sum("w")).first()[0]
    return ranks.select("rank", (F.sum("w").over(so_far) / every).alias("upto"))


def zipf_orders(spark: SparkSession, n: int, max_time: int, stocks: int, skew: float, seed: int = 0, first: int = 0) -> DataFrame:
    """Orders whose stock of rank r has a share in proportion to r ^ -skew.

    Stocks are s-``first`` and on.  The distribution is inverted by a search in
    its table, which has one number per stock and travels with the plan.
    """
    ends = [r["upto"] for r in zipf(spark, stocks, skew).orderBy("rank").collect()]
    table = spark.createDataFrame([(ends,)], "ends array<double>")
    rows = spark.range(n).select(_uniform(0, max_time, seed).alias("time"), F.rand(seed + 1).alias("u"), _uniform(0, 100, seed + 2).alias("amount"))

    # binary search: the number of ends at or under u
    steps = max(1, len(ends)).bit_length()
    found = F.lit(0)
    rows = rows.join(F.broadcast(table)) if len(ends) else rows.limit(0).withColumn("ends", F.array().cast("array<double>"))
    for k in range(steps - 1, -1, -1):
        jump = 1 << k
        rows = rows.withColumn("at", found if k == steps - 1 else F.col("at"))
        inside = (F.col("at") + jump <= len(ends)) & F.coalesce(F.get("ends", F.col("at") + (jump - 1)) <= F.col("u"), F.lit(False))
        rows = rows.withColumn("at", F.when(inside, F.col("at") + jump).otherwise(F.col("at")))
    return rows.select("time", _stock(F.least(F.col("at"), F.lit(len(ends) - 1)) + first).alias("stock"), "amount")


def tick_prices(spark: SparkSession, ticks: int, stocks: int, step: int = 10, seed: int = 0) -> DataFrame:
    """Every stock S-0 to S-(n-1) at every tick; price 0 to 99."""
    grid = spark.range(ticks * stocks)
    return grid.select((F.floor(F.col("id") / stocks) * step).cast("long").alias("time"), _stock((F.col("id") % stocks), "S-").alias("stock"), _uniform(0, 99, seed).alias("price"))


def tick_orders(spark: SparkSession, n: int, start: int, end: int, stocks: int, seed: int = 0, skew: float | None = None) -> DataFrame:
    """Orders in [start, end) of stocks S-0 to S-(n-1), uniform or by a zipf law; amount 0 to 99."""
    if skew is not None:
        drawn = zipf_orders(spark, n, 0, stocks, skew, seed + 1).select(F.regexp_replace("stock", "^s-", "S-").alias("stock"), F.monotonically_increasing_id().alias("i"))
        return drawn.select(_uniform(start, end - 1, seed).alias("time"), "stock", _uniform(0, 99, seed + 5).alias("amount"))
    return spark.range(n).select(_uniform(start, end - 1, seed).alias("time"), _stock(_uniform(0, stocks - 1, seed + 1), "S-").alias("stock"), _uniform(0, 99, seed + 2).alias("amount"))


def mid_prices(bars: DataFrame, time: str = "time", high: str = "high", low: str = "low", stock: str = "BTC") -> DataFrame:
    """Bars to prices: the middle of high and low, in whole cents."""
    return bars.select(F.col(time).cast("long").alias("time"), F.lit(stock).alias("stock"), F.floor((F.col(high) + F.col(low)) / 2 * 100).cast("long").alias("price"))


def resampled(prices: DataFrame, step: int = 10) -> DataFrame:
    """Prices on a grid of ``step`` within each gap, interpolated linearly, per stock."""
    from pyspark.sql import Window

    order = Window.partitionBy("stock").orderBy("time")
    gaps = prices.select("*", F.lead("time").over(order).alias("t2"), F.lead("price").over(order).alias("p2"))
    last = F.coalesce(F.greatest(F.col("time"), F.col("t2") - 1), F.col("time"))
    points = gaps.select("*", F.explode(F.sequence("time", last, F.lit(step).cast("long"))).alias("at"))
    share = (F.col("at") - F.col("time")) / F.nullif(F.col("t2") - F.col("time"), F.lit(0))
    return points.select(F.col("at").alias("time"), "stock", F.floor(F.col("price") + F.coalesce(share * (F.col("p2") - F.col("price")), F.lit(0.0))).cast("long").alias("price"))


def orders_within(prices: DataFrame, n: int, stock: str = "BTC", seed: int = 0) -> DataFrame:
    """``n`` orders of one stock, uniform over the time that its prices span; none without prices."""
    span = prices.filter(F.col("stock") == stock).agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
    spark = prices.sparkSession
    if span["a"] is None:
        return spark.createDataFrame([], "time long, stock string, amount long")
    return spark.range(n).select(_uniform(span["a"], span["b"], seed).alias("time"), F.lit(stock).alias("stock"), _uniform(0, 99, seed + 1).alias("amount"))


#: Skews of a batch of order books; None is uniform.  Fixed values.
SKEWS = (None, 1.1, 1.3, 1.5, 2.0)


def order_books(spark: SparkSession, sizes: Sequence[int], end: int, stocks: int, skews: Sequence[float | None] = SKEWS, seed: int = 0) -> dict[tuple[float | None, int], DataFrame]:
    """An order book for each skew and size."""
    return {(skew, n): tick_orders(spark, n, 0, end, stocks, seed + k, skew) for k, (skew, n) in enumerate((s, n) for s in skews for n in sizes)}


def percentile_books(spark: SparkSession, n: int, max_time: int, stocks: int, shares: Sequence[float], seed: int = 0) -> dict[float, DataFrame]:
    """Orders that begin after each share of the feed's time."""
    return {p: uniform_orders(spark, n, max_time, stocks, int(p * max_time), seed) for p in shares}
