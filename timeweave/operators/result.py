"""The value of a matched pair and its sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT = "decimal(20,0)"


def asof_value(matched: DataFrame, price: str = "price", amount: str = "amount") -> DataFrame:
    """With ``value``, the product; whole numbers multiply as decimals and can't overflow."""
    whole = all(matched.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in (price, amount))
    p, a = (F.col(c).cast(EXACT) if whole else F.col(c) for c in (price, amount))
    return matched.withColumn("value", p * a)


def seven_columns(orders: DataFrame, prices: DataFrame, **options) -> DataFrame:
    """``price_time, price_stock, price, order_time, order_stock, amount, value``."""
    from timeweave.operators.asof import asof_join

    pairs = asof_value(asof_join(orders, prices, "stock", **options))
    return pairs.select(F.col("time_right").alias("price_time"), F.col("stock").alias("price_stock"), "price", F.col("time").alias("order_time"), F.col("stock").alias("order_stock"), "amount", "value")


def asof_summary(valued: DataFrame, value: str = "value") -> DataFrame:
    """One row: number of pairs and the sum of their values (0 for none)."""
    return valued.agg(F.count("*").alias("size"), F.coalesce(F.sum(value), F.lit(0)).alias("value_sum"))
