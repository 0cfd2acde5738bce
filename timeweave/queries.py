"""The library's queries over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.operators.asof import asof_join
from timeweave.operators.result import asof_summary, seven_columns
from timeweave.operators.rows import earliest_at_or_after, first_n, forward_fill, latest_at_or_before, shuffled, with_known_keys
from timeweave.plans.chooser import NAMED
from timeweave.sources import generators, tables
from timeweave.streaming.enrich import enriched

MONEY = "decimal(18,2)"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _events(spark: SparkSession, folder: str, kind: str, **names: str) -> DataFrame:
    rows = _table(spark, folder, "events").filter(F.col("event_type") == kind)
    return rows.select(*[F.col(c).alias(a) for a, c in names.items()])


def _orders(spark, folder):
    return _events(spark, folder, "purchase", order_id="event_id", user_id="user_id", ts="ts", amount="value")


def _prices(spark, folder):
    return _events(spark, folder, "view", price_id="event_id", user_id="user_id", view_ts="ts", price="value")


def rows(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Purchases with the user's latest view: identities, times and the pair's value."""
    m = asof_join(_orders(spark, folder), _prices(spark, folder), "user_id", "ts", "view_ts", **options)
    value = (F.col("price").cast(MONEY) * F.col("amount").cast(MONEY)).cast("decimal(38,4)")
    return m.select("order_id", "price_id", "user_id", "ts", "view_ts", F.col("price").cast(MONEY).alias("price"), F.col("amount").cast(MONEY).alias("amount"), value.alias("value"))


def one_sided(spark: SparkSession, folder: str, how: str, **options) -> DataFrame:
    m = asof_join(_orders(spark, folder), _prices(spark, folder), "user_id", "ts", "view_ts", how=how, **options)
    shown = ["order_id", "user_id"] if how in ("semi", "anti") else ["order_id", "price_id", "user_id"]
    return m.select(*shown)


def supply(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Order lines with the supplier's dearest line by ship date; number of pairs and sum of values."""
    lines, orders = _table(spark, folder, "lineitem"), _table(spark, folder, "orders")
    left = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("l_suppkey").alias("k"), F.col("o_orderdate").alias("t"), F.col("l_quantity").cast(MONEY).alias("amount"))
    right = lines.groupBy(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("t")).agg(F.max("l_extendedprice").cast(MONEY).alias("price"))
    m = asof_join(left, right, "k", "t", "t", **options)
    return asof_summary(m.select((F.col("price") * F.col("amount")).alias("value"))).select("size", F.col("value_sum").cast("decimal(38,4)").alias("value_sum"))


def same_time(spark: SparkSession, folder: str) -> DataFrame:
    lines = _table(spark, folder, "lineitem")
    feed = lines.groupBy(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("t")).agg(F.max("l_extendedprice").cast(MONEY).alias("price"))
    left = lines.select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("t"), F.col("l_quantity").cast(MONEY).alias("amount"))
    return asof_summary(asof_join(left, feed, "k", "t", "t", "equal").select((F.col("price") * F.col("amount")).alias("value"))).select("size", F.col("value_sum").cast("decimal(38,4)").alias("value_sum"))


def no_key(spark: SparkSession, folder: str) -> DataFrame:
    errors = _events(spark, folder, "error", error_id="event_id", error_ts="ts")
    errors = errors.groupBy("error_ts").agg(F.max("error_id").alias("error_id"))
    return asof_join(_orders(spark, folder), errors, (), "ts", "error_ts").select("order_id", "error_id", "ts", "error_ts")


def searched(spark: SparkSession, folder: str, search) -> DataFrame:
    return search(_orders(spark, folder), _prices(spark, folder), ["user_id"], "ts", "view_ts").select("order_id", "price_id")


def filled(spark: SparkSession, folder: str) -> DataFrame:
    events = _table(spark, folder, "events").withColumn("seen", F.when(F.col("event_type") == "view", F.col("value").cast(MONEY)))
    return forward_fill(events, ["user_id"], ["ts", "event_id"], "seen", "last_view").select("event_id", "user_id", "last_view")


def firsts(spark: SparkSession, folder: str) -> DataFrame:
    return first_n(_table(spark, folder, "events").select("event_id", "user_id", "ts"), 100, "event_id")


def known(spark: SparkSession, folder: str) -> DataFrame:
    return with_known_keys(_orders(spark, folder), _prices(spark, folder), ["user_id"]).select("order_id", "user_id")


#: Rows whose sums are known, as (time, stock, number).
_B = 978307200
KNOWN = {
    "small": (
        [(_B + 60 * i, s, i + 1) for s in ("APPL", "MSFT", "GOOG") for i in range(3)],
        [(_B - 30 + 60 * i, s, a) for s, amounts in (("APPL", (516, 294, 2413)), ("GOOG", (933, 2345, 1058)), ("DATA", (665, 1795, 1837))) for i, a in enumerate(amounts)],
    ),
    "filter min": (
        [(19, "S1", 1), (18, "S2", 2), (20, "S3", 3), (10, "S2", 4), (5, "S2", 5), (11, "S2", 6), (19, "S3", 7), (16, "S2", 8), (15, "S2", 9)],
        [(20, "S1", 5), (17, "S2", 50), (21, "S3", 100)],
    ),
    "filter min right": (
        [(20, "S1", 5), (17, "S2", 50), (21, "S3", 100)],
        [(25, "S1", 1), (30, "S3", 20), (23, "S1", 30), (19, "S1", 40), (23, "S3", 4), (19, "S2", 2), (20, "S3", 3), (10, "S2", 4), (5, "S2", 5), (11, "S2", 6), (19, "S3", 7), (18, "S2", 8), (15, "S2", 9)],
    ),
}


def _written(spark: SparkSession, rows: list[tuple], names: list[str], header: bool) -> str:
    path = tables.scratch_path(spark, "csv")
    spark.createDataFrame(rows, "time long, stock string, number long").toDF(*names).coalesce(1).write.option("header", header).csv(path)
    return path


def known_sums(spark: SparkSession, folder: str) -> DataFrame:
    """The known sets through files: prices with a header, orders without one, read in a random order."""
    out = None
    for name, (prices, orders) in KNOWN.items():
        p, o = tables.load_data(spark, _written(spark, prices, ["time", "stock", "price"], True), _written(spark, orders, ["time", "stock", "amount"], False), shuffle=True)
        one = asof_summary(seven_columns(o, p)).select(F.lit(name).alias("name"), "size", F.col("value_sum").cast("long").alias("value_sum"))
        out = one if out is None else out.unionByName(one)
    return out


_MICROS = "datediff(ts, DATE'1970-01-01') * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT)"


def through_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases and views, with whole cents, written to CSV, loaded and joined."""
    events = _table(spark, folder, "events").select("event_type", F.expr(_MICROS).alias("time"), F.concat(F.lit("u"), "user_id").alias("stock"), (F.col("value").cast(MONEY) * 100).cast("long").alias("cents"))
    paths = {}
    for kind, name in (("view", "price"), ("purchase", "amount")):
        paths[kind] = tables.scratch_path(spark, "csv")
        tables.save(events.filter(F.col("event_type") == kind).select("time", "stock", F.col("cents").alias(name)), paths[kind], "csv")
    prices, orders = tables.load_data(spark, paths["view"], paths["purchase"])
    return seven_columns(orders, prices).select("price_time", "price_stock", "price", "order_time", "order_stock", "amount", F.col("value").cast("decimal(38,0)").alias("value"))


def streamed(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases as a stream of files, each batch joined with all views."""
    rows, out = tables.scratch_path(spark, "stream"), tables.scratch_path(spark, "streamed")
    _orders(spark, folder).repartition(3).write.parquet(rows)
    stream = spark.readStream.schema(spark.read.parquet(rows).schema).option("maxFilesPerTrigger", 1).parquet(rows)
    batch = enriched(stream, lambda: _prices(spark, folder), lambda df, _: df.select("order_id", "price_id", "user_id").write.mode("append").parquet(out), on="user_id", left_time="ts", right_time="view_ts", how="left")
    batch.option("checkpointLocation", tables.scratch_path(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def in_random_order(spark: SparkSession, folder: str) -> DataFrame:
    m = asof_join(shuffled(_orders(spark, folder), 1), shuffled(_prices(spark, folder), 2), "user_id", "ts", "view_ts", how="left")
    return m.select("order_id", "price_id", "user_id")


def regular(spark: SparkSession, folder: str) -> DataFrame:
    p = generators.regular_prices(spark, 2000, 5, 7)
    return p.select("time", (F.col("stock").isin([f"s-{i}" for i in range(8)]) & F.col("price").between(0, 100)).alias("in_range"))


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return generators.tick_prices(spark, 300, 4).select("time", "stock", F.col("price").between(0, 99).alias("in_range"))


def _summed(name: str, df: DataFrame, number: str, low: int, high: int, most: int) -> DataFrame:
    return df.agg(
        F.lit(name).alias("name"),
        F.count("*").alias("n"),
        F.count_distinct("stock").alias("stocks"),
        (F.min("time") >= low).alias("from_low"),
        (F.max("time") <= high).alias("to_high"),
        (F.max("time") > low + (high - low) * 0.99).alias("reaches_high"),
        F.bool_and(F.col(number).between(0, most)).alias("in_range"),
        F.mode("stock").alias("most_frequent") if name.startswith("zipf") else F.lit(None).cast("string").alias("most_frequent"),
    )


def generated(spark: SparkSession, folder: str) -> DataFrame:
    """What is certain of 20,000 random rows of each generator."""
    n = 20_000
    g = generators
    return (
        _summed("uniform prices", g.uniform_prices(spark, n, 1000, 9), "price", 0, 1000, 100)
        .unionByName(_summed("uniform orders", g.uniform_orders(spark, n, 1000, 9), "amount", 0, 1000, 100))
        .unionByName(_summed("late orders", g.uniform_orders(spark, n, 1000, 9, 750), "amount", 750, 1000, 100))
        .unionByName(_summed("zipf orders", g.zipf_orders(spark, n, 1000, 10, 1.1), "amount", 0, 1000, 100))
        .unionByName(_summed("zipf orders from 1", g.zipf_orders(spark, n, 1000, 10, 1.1, first=1), "amount", 0, 1000, 100))
        .unionByName(_summed("tick orders", g.tick_orders(spark, n, 10, 1011, 10), "amount", 10, 1010, 99))
        .unionByName(_summed("zipf tick orders", g.tick_orders(spark, n, 10, 1011, 10, skew=1.3), "amount", 10, 1010, 99))
        .unionByName(_summed("orders within", g.orders_within(g.tick_prices(spark, 101, 1), n, "S-0"), "amount", 0, 1000, 99))
    )


def resampled_views(spark: SparkSession, folder: str) -> DataFrame:
    """Views of the first users as bars, their middles, and a grid of an hour between them."""
    views = _table(spark, folder, "events").filter("event_type = 'view' AND user_id <= 20").select(F.expr(f"({_MICROS}) DIV 1000000").alias("time"), F.col("value").cast(MONEY).alias("v"), F.col("user_id"))
    bars = views.groupBy("time").agg(F.max("v").cast("double").alias("high"), F.min("v").cast("double").alias("low"))
    return generators.resampled(generators.mid_prices(bars), 3600)


_O = "(SELECT event_id AS order_id, user_id, ts, value AS amount FROM events WHERE event_type = 'purchase') o"
_P = "(SELECT event_id AS price_id, user_id, ts AS view_ts, value AS price FROM events WHERE event_type = 'view') p"


def _rows_sql(comparison: str = ">=", how: str = "") -> str:
    return f"""
SELECT order_id, price_id, o.user_id, ts, view_ts, CAST(price AS DECIMAL(18,2)) AS price, CAST(amount AS DECIMAL(18,2)) AS amount,
       CAST(CAST(price AS DECIMAL(18,2)) * CAST(amount AS DECIMAL(18,2)) AS DECIMAL(38,4)) AS value
FROM {_O} ASOF {how} JOIN {_P} ON o.user_id = p.user_id AND o.ts {comparison} p.view_ts"""


def _side_sql(how: str) -> str:
    if how in ("semi", "anti"):
        return f"SELECT order_id, user_id FROM {_O} ASOF {how.upper()} JOIN {_P} ON o.user_id = p.user_id AND o.ts >= p.view_ts"
    return f"SELECT order_id, price_id, coalesce(o.user_id, p.user_id) AS user_id FROM {_O} ASOF {how.upper()} JOIN {_P} ON o.user_id = p.user_id AND o.ts >= p.view_ts"


def _supply_sql(comparison: str) -> str:
    return f"""
SELECT count(*) AS size, CAST(sum(price * amount) AS DECIMAL(38,4)) AS value_sum
FROM (SELECT l_suppkey AS k, o_orderdate AS t, CAST(l_quantity AS DECIMAL(18,2)) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey) o
ASOF JOIN (SELECT l_suppkey AS k, l_shipdate AS t, CAST(max(l_extendedprice) AS DECIMAL(18,2)) AS price FROM lineitem GROUP BY ALL) p
ON o.k = p.k AND o.t {comparison} p.t"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = query
    ORACLE_SQL[name] = sql


for _name in NAMED:
    _key = "asof_rows_" + "_".join(_name.lower().replace("+", "").split())
    _add(_key, partial(rows, strategy=_name), _rows_sql())
_add("asof_rows_auto", rows, _rows_sql())
for _how in ("left", "right", "full", "semi", "anti"):
    _add(f"asof_{_how}", partial(one_sided, how=_how), _side_sql(_how))
_add("asof_forward_rows", partial(rows, direction="forward"), _rows_sql("<="))
_add("asof_value_sum", supply, _supply_sql(">="))
_add("asof_strict_before", partial(supply, allow_exact=False), _supply_sql(">"))
_add("asof_on_or_after", partial(supply, direction="forward"), _supply_sql("<="))
_add("asof_strict_after", partial(supply, direction="forward", allow_exact=False), _supply_sql("<"))
for _plan in ("fill", "probe_left", "probe_right", "bucketed"):  # nested is quadratic in the 600 rows of a supplier
    _add(f"asof_value_sum_{_plan}", partial(supply, strategy=_plan), _supply_sql(">="))
    _add(f"asof_strict_after_{_plan}", partial(supply, strategy=_plan, direction="forward", allow_exact=False), _supply_sql("<"))
_add("asof_strict_before_fill", partial(supply, strategy="fill", allow_exact=False), _supply_sql(">"))
_add("asof_on_or_after_fill", partial(supply, strategy="fill", direction="forward"), _supply_sql("<="))
for _how in ("right", "full"):
    _add(f"asof_{_how}_bucketed", partial(one_sided, how=_how, strategy="bucketed"), _side_sql(_how))
_add(
    "asof_same_time",
    same_time,
    """
SELECT count(*) AS size, CAST(sum(CAST(price AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,4)) AS value_sum
FROM lineitem JOIN (SELECT l_suppkey AS k, l_shipdate AS t, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL) ON l_suppkey = k AND l_shipdate = t""",
)
_add(
    "asof_no_key",
    no_key,
    f"SELECT order_id, error_id, ts, error_ts FROM {_O} ASOF JOIN (SELECT ts AS error_ts, max(event_id) AS error_id FROM events WHERE event_type = 'error' GROUP BY ts) p ON o.ts >= p.error_ts",
)
_add("static_min_filter", partial(rows, static_filter=True), _rows_sql())
_add("dynamic_min_filter", partial(rows, dynamic_filter=True), _rows_sql())
_add("search_less_equal", partial(searched, search=latest_at_or_before), f"SELECT order_id, price_id FROM {_O} ASOF LEFT JOIN {_P} ON o.user_id = p.user_id AND o.ts >= p.view_ts")
_add("search_greater_equal", partial(searched, search=earliest_at_or_after), f"SELECT order_id, price_id FROM {_O} ASOF LEFT JOIN {_P} ON o.user_id = p.user_id AND o.ts <= p.view_ts")
_add(
    "forward_fill",
    filled,
    """
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN CAST(value AS DECIMAL(18,2)) END IGNORE NULLS)
       OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_view FROM events""",
)
_add("first_n", firsts, "SELECT event_id, user_id, ts FROM events ORDER BY event_id LIMIT 100")
_add("key_semi", known, f"SELECT order_id, user_id FROM {_O} WHERE EXISTS (SELECT 1 FROM {_P} WHERE p.user_id = o.user_id)")
_values = lambda rows: ", ".join(f"({t}, '{s}', {n})" for t, s, n in rows)
_add(
    "csv_known_sums",
    known_sums,
    " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS size, CAST(coalesce(sum(price * amount), 0) AS BIGINT) AS value_sum "
        f"FROM (VALUES {_values(orders)}) o(time, stock, amount) ASOF JOIN (VALUES {_values(prices)}) p(time, stock, price) ON o.stock = p.stock AND o.time >= p.time"
        for name, (prices, orders) in KNOWN.items()
    ),
)
_cents = "CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT)"
_add(
    "csv_round_trip",
    through_csv,
    f"""
SELECT p.time AS price_time, p.stock AS price_stock, price, o.time AS order_time, o.stock AS order_stock, amount, CAST(CAST(price AS DECIMAL(38,0)) * amount AS DECIMAL(38,0)) AS value
FROM (SELECT epoch_us(ts) AS time, 'u' || user_id AS stock, {_cents} AS amount FROM events WHERE event_type = 'purchase') o
ASOF JOIN (SELECT epoch_us(ts) AS time, 'u' || user_id AS stock, {_cents} AS price FROM events WHERE event_type = 'view') p ON o.stock = p.stock AND o.time >= p.time""",
)
_add("stream_asof", streamed, _side_sql("left"))
_add("shuffled_asof", in_random_order, _side_sql("left"))
_add("generator_regular_prices", regular, "SELECT range * 5 AS time, true AS in_range FROM range(2000)")
_add("generator_tick_prices", ticks, "SELECT t.range * 10 AS time, 'S-' || s.range AS stock, true AS in_range FROM range(300) t, range(4) s")
_add(
    "generator_random",
    generated,
    """
SELECT name, CAST(20000 AS BIGINT) AS n, CAST(stocks AS BIGINT) AS stocks, true AS from_low, true AS to_high, true AS reaches_high, true AS in_range, most_frequent
FROM (VALUES ('uniform prices', 10, NULL), ('uniform orders', 10, NULL), ('late orders', 10, NULL), ('zipf orders', 10, 's-0'), ('zipf orders from 1', 10, 's-1'),
             ('tick orders', 10, NULL), ('zipf tick orders', 10, 'S-0'), ('orders within', 1, NULL)) t(name, stocks, most_frequent)""",
)
_add(
    "resampled_prices",
    resampled_views,
    """
WITH b AS (
  SELECT epoch_us(ts) // 1000000 AS time, CAST(max(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS high, CAST(min(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS low
  FROM events WHERE event_type = 'view' AND user_id <= 20 GROUP BY 1),
p AS (SELECT time, CAST(floor((high + low) / 2 * 100) AS BIGINT) AS price FROM b),
g AS (SELECT time, price, lead(time) OVER (ORDER BY time) AS t2, lead(price) OVER (ORDER BY time) AS p2 FROM p),
e AS (SELECT *, unnest(generate_series(time, coalesce(greatest(time, t2 - 1), time), 3600)) AS x FROM g)
SELECT x AS time, 'BTC' AS stock, CAST(floor(price + coalesce(CAST(x - time AS DOUBLE) / nullif(t2 - time, 0) * (p2 - price), 0)) AS BIGINT) AS price FROM e""",
)
