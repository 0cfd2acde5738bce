"""Times the headline queries and the usual shapes of this join; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.  Each query runs
once to warm up and then three times; ``queries`` has the best time, ``median``
the median.  ``shapes`` has both for generated tables: more and more keys, a
grid of sizes, zipf keys, orders after a percentile of the feed; they aren't part
of ``value``, and none begins once they have taken ``BENCH_SHAPES_SEC``.  Results go to Spark's noop sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from timeweave import asof_join, queries
from timeweave.sources import generators

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
HEADLINE = (
    "asof_rows_auto",
    "asof_rows_fill",
    "asof_rows_probe_right",
    "asof_rows_probe_left",
    "asof_rows_bucketed",
    "asof_value_sum",
    "asof_value_sum_probe_right",
    "asof_strict_before",
    "asof_on_or_after",
    "asof_left",
    "asof_right",
    "asof_semi",
    "asof_anti",
    "asof_no_key",
    "dynamic_min_filter",
    "forward_fill",
)
#: Rows of the shapes' feed, and seconds after which no further shape begins.
FEED, SHAPES_SEC = 1_000_000, float(os.environ.get("BENCH_SHAPES_SEC", "90"))


def shapes(spark: SparkSession) -> Iterator[tuple[str, Callable[[], DataFrame]]]:
    g = generators

    def joined(orders: DataFrame, prices: DataFrame, strategy: str = "fill") -> Callable[[], DataFrame]:
        return lambda: asof_join(orders, prices, "stock", strategy=strategy)

    for keys in (1, 32, 1024, 32_768):
        for strategy in ("fill", "bucketed"):
            yield f"keys_{keys}_{strategy}", joined(g.uniform_orders(spark, FEED, FEED, keys - 1), g.uniform_prices(spark, FEED, FEED, keys - 1, 7), strategy)
    for n in (FEED // 100, FEED):
        for m in (FEED // 100, FEED):
            yield f"grid_{n}_{m}", joined(g.uniform_orders(spark, n, FEED, 127), g.uniform_prices(spark, m, FEED, 127, 7))
    for skew in (0.5, 3.0):
        for strategy in ("fill", "bucketed"):
            yield f"zipf_{skew}_{strategy}", joined(g.zipf_orders(spark, FEED, FEED, 128, skew), g.uniform_prices(spark, FEED, FEED, 127, 7), strategy)
    for share, book in g.percentile_books(spark, FEED // 10, FEED, 7, (0.0, 0.5, 0.95)).items():
        for strategy in ("PARTITION LEFT", "PARTITION LEFT + FILTER MIN"):
            yield f"after_{share}_{strategy.lower().replace(' + ', '_').replace(' ', '_')}", joined(book, g.uniform_prices(spark, FEED, FEED, 7, 7), strategy)


def timed(make: Callable[[], DataFrame], runs: int) -> list[float]:
    """Seconds of each run but the first."""
    took = []
    for _ in range(runs + 1):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return took[1:]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    best, median = {}, {}
    for name in HEADLINE:
        took = timed(lambda name=name: queries.QUERIES[name](spark, FOLDER), RUNS)
        best[name], median[name] = round(min(took), 3), round(statistics.median(took), 3)
    shaped, began = {}, time.perf_counter()
    for name, make in shapes(spark):
        if time.perf_counter() - began > SHAPES_SEC:
            break
        took = timed(make, 2)
        shaped[name] = [round(min(took), 3), round(statistics.median(took), 3)]
    line = {"metric": "total_query_seconds", "value": round(sum(best.values()), 3), "unit": "sec", "queries": best, "median": median, "shapes": shaped}
    print(json.dumps(line | {"sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
