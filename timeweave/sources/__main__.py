"""Writes generated prices and orders: ``python -m timeweave.sources prices|orders|books OUT [options]``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from timeweave.sources import generators
from timeweave.sources.tables import save


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="timeweave.sources")
    kinds = out.add_subparsers(dest="kind", required=True)
    prices = kinds.add_parser("prices", help="every stock at every tick")
    orders = kinds.add_parser("orders", help="one order book")
    books = kinds.add_parser("books", help="an order book for each skew and size")
    for p in (prices, orders, books):
        p.add_argument("out")
        p.add_argument("--ticks", type=int, default=1000)
        p.add_argument("--stocks", type=int, default=10)
        p.add_argument("--seed", type=int, default=0)
        p.add_argument("--format", default="csv", choices=("csv", "parquet", "json", "orc"))
    orders.add_argument("--rows", type=int, default=1000)
    law = orders.add_mutually_exclusive_group()
    law.add_argument("--zipf", type=float, metavar="SKEW")
    law.add_argument("--uniform", action="store_true")
    books.add_argument("--sizes", type=int, nargs="+", default=[1000, 10_000])
    return out


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("timeweave.sources").getOrCreate()
    end = 10 * a.ticks
    if a.kind == "prices":
        save(generators.tick_prices(spark, a.ticks, a.stocks, seed=a.seed), a.out, a.format)
    elif a.kind == "orders":
        save(generators.tick_orders(spark, a.rows, 0, 10 + end, a.stocks, a.seed, a.zipf), a.out, a.format)
    else:
        for (skew, n), book in generators.order_books(spark, a.sizes, 10 + end, a.stocks, seed=a.seed).items():
            save(book, f"{a.out}/{'uniform' if skew is None else f'zipf-{skew}'}-{n}", a.format)


if __name__ == "__main__":
    main()
