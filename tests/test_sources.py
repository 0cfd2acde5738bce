"""Readers, generators, searches, row operators and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave import asof_join
from timeweave.functions import search as s
from timeweave.operators.rows import first_n, forward_fill, shuffled, with_known_keys
from timeweave.sources import generators as g
from timeweave.sources.tables import load_data, load_order_book, load_prices, save
from timeweave.streaming.enrich import enriched


def test_csv_with_and_without_header(spark, tmp_path):
    (tmp_path / "h.csv").write_bytes(b"time,stock,price\r\n5,A,1\r\n6,B,2\r\n")
    (tmp_path / "n.csv").write_text("5|A|1\n6|B|2")
    want = [(5, "A", 1), (6, "B", 2)]
    assert sorted(map(tuple, load_prices(spark, str(tmp_path / "h.csv")).collect())) == want
    orders = load_order_book(spark, str(tmp_path / "n.csv"), "|")
    assert orders.columns == ["time", "stock", "amount"] and sorted(map(tuple, orders.collect())) == want
    p, o = load_data(spark, str(tmp_path / "h.csv"), str(tmp_path / "h.csv"), shuffle=True)
    assert p.count() == o.count() == 2


def test_bad_rows_raise(spark, tmp_path):
    (tmp_path / "x.csv").write_text("5,A,one\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        load_prices(spark, str(tmp_path / "x.csv")).collect()


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    for kind in ("parquet", "csv", "json", "orc"):
        save(df, str(tmp_path / kind), kind)
        assert spark.read.format(kind).option("header", True).load(str(tmp_path / kind)).count() == 3


def test_generators(spark):
    p = g.regular_prices(spark, 500, 7, 3)
    assert p.agg(F.max("time")).first()[0] == 499 * 7 and {r[0] for r in p.select("stock").distinct().collect()} == {f"s-{i}" for i in range(4)}
    for df, value in ((g.uniform_prices(spark, 500, 50, 3), "price"), (g.uniform_orders(spark, 500, 50, 3, min_time=20), "amount")):
        r = df.agg(F.min("time"), F.max("time"), F.min(value), F.max(value)).first()
        assert 0 <= r[0] and r[1] <= 50 and 0 <= r[2] and r[3] <= 100
    assert g.uniform_orders(spark, 500, 50, 3, min_time=20).agg(F.min("time")).first()[0] >= 20
    z = {r["stock"]: r["count"] for r in g.zipf_orders(spark, 20_000, 100, 5, 1.0).groupBy("stock").count().collect()}
    share = [1 / r for r in range(1, 6)]
    for i in range(5):
        assert abs(z[f"s-{i}"] / 20_000 - share[i] / sum(share)) < 0.02
    t = g.tick_prices(spark, 4, 3)
    assert t.count() == 12 and {r[0] for r in t.select("time").distinct().collect()} == {0, 10, 20, 30}
    assert g.tick_orders(spark, 50, 5, 9, 2).filter("time < 5 OR time >= 9 OR amount > 99").count() == 0
    assert sorted(map(tuple, g.uniform_orders(spark, 50, 50, 3, seed=4).collect())) == sorted(map(tuple, g.uniform_orders(spark, 50, 50, 3, seed=4).collect()))


def test_bars_and_resampling(spark):
    bars = spark.createDataFrame([(0, 1.5, 0.5), (40, 3.0, 2.0)], "time long, high double, low double")
    p = g.mid_prices(bars)
    assert [tuple(r) for r in p.orderBy("time").collect()] == [(0, "BTC", 100), (40, "BTC", 250)]
    assert [(r["time"], r["price"]) for r in g.resampled(p, 10).orderBy("time").collect()] == [(0, 100), (10, 137), (20, 175), (30, 212), (40, 250)]


def test_searches():
    data = np.array([1, 3, 3, 7])
    t = np.array([0, 1, 3, 5, 7, 9])
    assert s.less_equal(data, t).tolist() == [-1, 0, 2, 2, 3, 3]
    assert s.less(data, t).tolist() == [-1, -1, 0, 2, 2, 3]
    assert s.greater_equal(data, t).tolist() == [0, 0, 1, 3, 3, -1]
    assert s.greater(data, t).tolist() == [0, 1, 3, 3, -1, -1]
    assert s.less_equal(np.array([5, 5]), np.array([5])).tolist() == [1]
    assert s.greater_equal(np.array([]), np.array([5])).tolist() == [-1]


def test_row_operators(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, "a", None), (4, "b", None)], "t long, k string, v long")
    assert [r["f"] for r in forward_fill(df, ["k"], ["t"], "v", "f").orderBy("t").collect()] == [None, 5, 5, None]
    assert [r["t"] for r in first_n(df, 2, F.desc("t")).collect()] == [4, 3]
    assert sorted(r["t"] for r in shuffled(df, 3).collect()) == [1, 2, 3, 4]
    assert [r["t"] for r in with_known_keys(df, df.filter("k = 'b'"), ["k"]).collect()] == [4]


def test_stream_against_a_table(spark, tmp_path):
    spark.createDataFrame([(5, "k", 1), (9, "k", 2)], "time long, stock string, amount long").write.parquet(str(tmp_path / "in"))
    feed = spark.createDataFrame([(4, "k", 10), (8, "k", 20)], "time long, stock string, price long")
    stream = spark.readStream.schema("time long, stock string, amount long").parquet(str(tmp_path / "in"))
    writer = enriched(stream, lambda: feed, lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")), on="stock")
    q = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["amount"], r["price"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 10), (2, 20)]
    assert asof_join(feed, feed, "stock").count() == 2


def test_a_folder_of_mixed_headers(spark, tmp_path):
    from timeweave.sources.tables import load_prices

    (tmp_path / "a.csv").write_text("time,stock,price\n1,x,5\n2,y,6\n")
    (tmp_path / "b.csv").write_text("3,x,7\r\n4,y,8")
    (tmp_path / "c.csv").write_text("")
    assert sorted(map(tuple, load_prices(spark, str(tmp_path)).collect())) == [(1, "x", 5), (2, "y", 6), (3, "x", 7), (4, "y", 8)]
    (tmp_path / "d.csv").write_text("5,x,seven\n")
    with pytest.raises(Exception, match="MALFORMED|BAD"):
        load_prices(spark, str(tmp_path)).collect()


def test_command_line(spark, tmp_path):
    from timeweave.sources.__main__ import main
    from timeweave.sources.tables import load_order_book, load_prices

    main(["prices", str(tmp_path / "p"), "--ticks", "20", "--stocks", "3"], spark)
    assert load_prices(spark, str(tmp_path / "p")).count() == 60
    main(["orders", str(tmp_path / "o"), "--rows", "50", "--zipf", "1.5"], spark)
    assert load_order_book(spark, str(tmp_path / "o")).count() == 50
    main(["books", str(tmp_path / "b"), "--sizes", "10", "20", "--format", "parquet"], spark)
    assert sorted(p.name for p in (tmp_path / "b").iterdir()) == sorted(f"{law}-{n}" for law in ("uniform", "zipf-1.1", "zipf-1.3", "zipf-1.5", "zipf-2.0") for n in (10, 20))
    with pytest.raises(SystemExit):
        main(["orders", "x", "--zipf", "1", "--uniform"], spark)


def test_books_and_orders_within(spark):
    from timeweave.sources import generators as g

    late = g.percentile_books(spark, 200, 1000, 3, [0.0, 0.9])
    assert late[0.9].agg({"time": "min"}).first()[0] >= 900 > late[0.0].agg({"time": "min"}).first()[0]
    prices = g.tick_prices(spark, 5, 1)
    assert g.orders_within(prices, 100, "S-0").filter("time < 0 OR time > 40").count() == 0
    assert g.orders_within(prices, 100, "none").count() == 0
