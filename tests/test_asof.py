"""The as-of join: known sums, ties, nulls, empty sides, and all strategies against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from timeweave import asof_join, asof_summary, asof_value
from timeweave.operators.result import seven_columns
from timeweave.plans import probe
from timeweave.plans.chooser import NAMED, cost

PLANS = ["fill", "nested", "probe_right", "probe_left", "bucketed"]
PRICE, ORDER = "time long, stock string, price long", "time long, stock string, amount long"
B = 978307200
# fixed values: rows whose sums are known
SMALL_PRICES = [(B + 60 * i, s, i + 1) for s in ("APPL", "MSFT", "GOOG") for i in range(3)]
SMALL_ORDERS = [(B - 30 + 60 * i, s, a) for s, amounts in (("APPL", (516, 294, 2413)), ("GOOG", (933, 2345, 1058)), ("DATA", (665, 1795, 1837))) for i, a in enumerate(amounts)]
LEFT_PRICES = [(19, "S1", 1), (18, "S2", 2), (20, "S3", 3), (10, "S2", 4), (5, "S2", 5), (11, "S2", 6), (19, "S3", 7), (16, "S2", 8), (15, "S2", 9)]
THREE = [(20, "S1", 5), (17, "S2", 50), (21, "S3", 100)]
MANY_ORDERS = [(25, "S1", 1), (30, "S3", 20), (23, "S1", 30), (19, "S1", 40), (23, "S3", 4), (19, "S2", 2), (20, "S3", 3), (10, "S2", 4), (5, "S2", 5), (11, "S2", 6), (19, "S3", 7), (18, "S2", 8), (15, "S2", 9)]


@pytest.mark.parametrize("strategy", sorted(NAMED))
@pytest.mark.parametrize(
    ("prices", "orders", "size", "total"),
    [(SMALL_PRICES, SMALL_ORDERS, 4, 9581), (LEFT_PRICES, THREE, 3, 705), (THREE, MANY_ORDERS, 6, 3055)],
)
def test_known_sums(spark, strategy, prices, orders, size, total):
    p, o = spark.createDataFrame(prices, PRICE), spark.createDataFrame(orders, ORDER)
    r = asof_summary(asof_value(asof_join(o, p, "stock", strategy=strategy))).first()
    assert (r["size"], int(r["value_sum"])) == (size, total)


def test_seven_columns(spark):
    p, o = spark.createDataFrame(SMALL_PRICES, PRICE), spark.createDataFrame(SMALL_ORDERS, ORDER)
    out = seven_columns(o, p)
    assert out.columns == ["price_time", "price_stock", "price", "order_time", "order_stock", "amount", "value"]
    assert sorted((r["price_stock"], r["price"], r["amount"], int(r["value"])) for r in out.collect()) == [("APPL", 1, 294, 294), ("APPL", 2, 2413, 4826), ("GOOG", 1, 2345, 2345), ("GOOG", 2, 1058, 2116)]


def expected(left, right, direction, exact, how):
    """By a plain loop over rows (id, key, time, ...)."""
    out, taken = [], set()
    for a in left:
        best = None
        for j, b in enumerate(right):
            if None in (a[1], a[2], b[1], b[2]) or a[1] != b[1]:
                continue
            gap = a[2] - b[2] if direction == "backward" else b[2] - a[2]
            if gap < 0 or (gap == 0 and not exact):
                continue
            rank = (-gap, b[3] is not None, b[3] or 0, b[0])
            if best is None or rank > best[0]:
                best = (rank, j)
        if best:
            taken.add(best[1])
            if how in ("inner", "left", "right", "full"):
                out.append((a[0], right[best[1]][0]))
            elif how == "semi":
                out.append((a[0],))
        elif how in ("left", "full"):
            out.append((a[0], None))
        elif how == "anti":
            out.append((a[0],))
    if how in ("right", "full"):
        out += [(None, b[0]) for j, b in enumerate(right) if j not in taken]
    return sorted(out, key=repr)


def random_rows(seed, n_left, n_right, keys, times):
    r = random.Random(seed)
    pick = lambda xs: r.choice([*xs, None]) if r.random() < 0.1 else r.choice(xs)
    left = [(i, pick(keys), pick(range(times))) for i in range(n_left)]
    right = [(1000 + i, pick(keys), pick(range(times)), r.choice([None, 1, 2, 3])) for i in range(n_right)]
    return left, right


CASES = {"many": (1, 40, 40, ["a", "b", "c"], 12), "one key": (2, 30, 30, ["a"], 40), "empty left": (3, 0, 10, ["a"], 5), "empty right": (4, 10, 0, ["a"], 5), "sparse": (5, 15, 8, list("abcdefgh"), 30)}


@pytest.mark.parametrize("strategy", PLANS)
@pytest.mark.parametrize("case", CASES)
def test_against_a_loop(spark, strategy, case):
    left, right = random_rows(*CASES[case])
    a = spark.createDataFrame(left, "id long, k string, t long")
    b = spark.createDataFrame(right, "rid long, k string, rt long, v long")
    for direction, exact in (("backward", True), ("backward", False), ("forward", True), ("forward", False)):
        for how in ("left",) if strategy != "fill" else ("inner", "left", "right", "full", "semi", "anti") if case == "many" else ("full",):
            out = asof_join(a, b, "k", "t", "rt", direction, exact, how, tie_break=["v", "rid"], strategy=strategy)
            shown = ["id"] if how in ("semi", "anti") else ["id", "rid"]
            got = sorted((tuple(r) for r in out.select(*shown).collect()), key=repr)
            assert got == expected(left, right, direction, exact, how), (direction, exact, how)


@pytest.mark.parametrize("strategy", PLANS)
def test_no_key_and_two_keys(spark, strategy):
    left, right = random_rows(7, 25, 25, ["a", "b"], 20)
    left, right = [(i, "x", t) for i, _, t in left], [(i, "x", t, v) for i, _, t, v in right]
    a = spark.createDataFrame(left, "id long, k string, t long")
    b = spark.createDataFrame(right, "rid long, k string, rt long, v long")
    want = expected(left, right, "backward", True, "inner")
    plain = asof_join(a.drop("k"), b.drop("k"), (), "t", "rt", tie_break=["v", "rid"], strategy=strategy)
    assert sorted((tuple(r) for r in plain.select("id", "rid").collect()), key=repr) == want
    two = asof_join(a.withColumn("m", F.lit(1)), b.withColumn("m", F.lit(1)), ["k", "m"], "t", "rt", tie_break=["v", "rid"], strategy=strategy)
    assert sorted((tuple(r) for r in two.select("id", "rid").collect()), key=repr) == want


NAN = float("nan")


@pytest.mark.parametrize("strategy", PLANS)
@pytest.mark.parametrize(("direction", "exact"), [("backward", True), ("backward", False), ("forward", True), ("forward", False)])
def test_every_plan_gives_one_answer(spark, strategy, direction, exact):
    """All kinds of join, with NaN and signed zeros among the keys, repeated times and left columns named like inner ones."""
    r = random.Random(17)
    keys = [NAN, 0.0, -0.0, 1.5, None]
    left = [(i, r.choice(keys), r.choice([*range(9), None])) for i in range(45)]
    right = [(1000 + i, r.choice(keys), r.choice([*range(9), None]), r.choice([None, 1, 2, 3])) for i in range(45)]
    same = lambda k: None if k is None else "nan" if k != k else abs(k)
    named = [*["id", "k", "t"], "__m", "__n", "__row", "__to", "__r", "__t", "__k0", "__side", "a.b"]
    a = spark.createDataFrame([(*x, *["mine"] * 9) for x in left], "id long, k double, t long, " + ", ".join(f"`{c}` string" for c in named[3:]))
    b = spark.createDataFrame(right, "rid long, k double, rt long, v long")
    plain = [[(x[0], same(x[1]), *x[2:]) for x in side] for side in (left, right)]
    for how in ("inner", "left", "right", "full", "semi", "anti"):
        out = asof_join(a, b, "k", "t", "rt", direction, exact, how, tie_break=["v", "rid"], strategy=strategy)
        assert out.columns[: len(named)] == named
        got = out.select("id", *([] if how in ("semi", "anti") else ["rid"]), "`__n`", "`a.b`").collect()
        assert sorted((tuple(x)[:-2] for x in got), key=repr) == expected(*plain, direction, exact, how), how
        assert {tuple(x)[-2:] for x in got} <= {("mine", "mine"), (None, None)}
        if how != "full":
            continue
        default = asof_join(a, b.select("k", "rt", "v", "rid"), "k", "t", "rt", direction, exact, how, strategy=strategy)  # ties by v and rid as well
        assert sorted((tuple(x) for x in default.select("id", *([] if how in ("semi", "anti") else ["rid"])).collect()), key=repr) == expected(*plain, direction, exact, how), how


def test_right_rows_keep_their_keys(spark):
    a = spark.createDataFrame([(1, "x", 5)], "id int, k string, t int")
    b = spark.createDataFrame([("x", 9, 1), ("y", 1, 2), (None, 1, 3), ("x", 4, 4), ("x", 4, 4)], "k string, t long, v long")
    got = sorted((tuple(r) for r in asof_join(a, b, "k", "t", "t", how="full").collect()), key=repr)
    assert got == sorted([(1, "x", 5, 4, 4), (None, "x", None, 4, 4), (None, "x", None, 9, 1), (None, "y", None, 1, 2), (None, None, None, 1, 3)], key=repr)
    plan = asof_join(a, b, "k", "t", "t", how="full")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_buckets_follow_the_rows(spark, monkeypatch):
    from timeweave.plans import bucketed as module

    assert module.how_many(10) == 64 and module.how_many(10**9) == 1000 and module.how_many(10**13) == module.MOST_BUCKETS
    rows = spark.range(3000).selectExpr("CAST(id AS DOUBLE) AS x")
    cuts = [float(c) for c in range(0, 3000, 7)]
    got = {r["x"]: r["b"] for r in rows.select("x", module.bucket_of(F.col("x"), cuts).alias("b")).collect()}
    assert got == {float(i): sum(c <= i for c in cuts) for i in range(3000)}
    # one key: no bucket holds more than a few times its share
    sizes = []
    real = module.bucket_of
    monkeypatch.setattr(module, "bucket_of", lambda number, cuts: sizes.append(cuts) or real(number, cuts))
    a = spark.range(4000).selectExpr("'k' AS k", "id AS t")
    assert asof_join(a, a, "k", "t", "t", strategy="bucketed").count() == 4000
    per = spark.range(4000).select(real(F.col("id").cast("double"), sizes[0]).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
    assert per <= 4 * 4000 / 64


def test_a_strategy_of_ones_own(spark):
    from timeweave.plans import chooser
    from timeweave.plans.fill import fill

    seen = []
    chooser.register("own", lambda left, right, spec, note: seen.append(note) or fill(left, right, spec), note=5)
    try:
        p, o = spark.createDataFrame(SMALL_PRICES, PRICE), spark.createDataFrame(SMALL_ORDERS, ORDER)
        assert asof_summary(asof_value(asof_join(o, p, "stock", strategy="own"))).first()["size"] == 4 and seen == [5]
        with pytest.raises(ValueError):
            chooser.register("fill", fill)
    finally:
        chooser.NAMED.pop("own"), chooser.PLANS.pop("own")


@pytest.mark.parametrize("name", ["asof_value_sum", "asof_strict_before", "asof_on_or_after", "asof_strict_after"])
def test_auto_stays_in_the_jvm_above_a_join(spark, name):
    """The estimate of a join's size passes the probe's threshold; the sizes of what it reads don't."""
    import os

    from timeweave import queries

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan


@pytest.mark.parametrize("strategy", ["probe_right", "probe_left"])
def test_wide_rows_are_not_broadcast(spark, strategy, monkeypatch):
    monkeypatch.setattr(probe, "LIMIT_BYTES", 100)
    p, o = spark.createDataFrame(SMALL_PRICES, PRICE), spark.createDataFrame(SMALL_ORDERS, ORDER)
    out = asof_join(o, p, "stock", strategy=strategy)
    assert "InArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert asof_summary(asof_value(out)).first()["value_sum"] == 9581


@pytest.mark.parametrize("strategy", ["probe_right", "probe_left"])
def test_probe_beyond_its_limit(spark, strategy, monkeypatch):
    left, right = random_rows(8, 30, 30, ["a", "b"], 15)
    a = spark.createDataFrame(left, "id long, k string, t long")
    b = spark.createDataFrame(right, "rid long, k string, rt long, v long")
    for module_default in (probe.probe_right, probe.probe_left):
        monkeypatch.setattr(module_default, "__defaults__", (3, *module_default.__defaults__[1:]))
    for direction, exact in (("backward", True), ("forward", False)):
        out = asof_join(a, b, "k", "t", "rt", direction, exact, tie_break=["v", "rid"], strategy=strategy)
        assert sorted((tuple(r) for r in out.select("id", "rid").collect()), key=repr) == expected(left, right, direction, exact, "inner")


def test_filters_change_nothing(spark):
    left, right = random_rows(9, 40, 60, ["a", "b", "c"], 25)
    a = spark.createDataFrame(left, "id long, k string, t long")
    b = spark.createDataFrame(right, "rid long, k string, rt long, v long")
    for direction, exact in (("backward", True), ("backward", False), ("forward", True), ("forward", False)):
        for how in ("inner", "left", "semi", "anti"):
            out = asof_join(a, b, "k", "t", "rt", direction, exact, how, tie_break=["v", "rid"], static_filter=True, dynamic_filter=True)
            shown = ["id"] if how in ("semi", "anti") else ["id", "rid"]
            assert sorted((tuple(r) for r in out.select(*shown).collect()), key=repr) == expected(left, right, direction, exact, how)


@pytest.mark.parametrize("strategy", PLANS)
def test_exact_hit_among_gaps_and_equal_times(spark, strategy):
    b = spark.createDataFrame([(0, "k", 1), (1, "k", 2), (2, "k", 3), (100, "k", 4)], PRICE)
    a = spark.createDataFrame([(2, "k", 1)], ORDER)
    assert [r["price"] for r in asof_join(a, b, "stock", strategy=strategy).collect()] == [3]
    same = spark.createDataFrame([(5, "k", 7), (5, "k", 9), (5, "k", 8)], PRICE)
    five = spark.createDataFrame([(5, "k", 1)], ORDER)
    assert [r["price"] for r in asof_join(five, same, "stock", strategy=strategy).collect()] == [9]
    assert [r["price"] for r in asof_join(five, same, "stock", direction="forward", strategy=strategy).collect()] == [9]


@pytest.mark.parametrize("strategy", PLANS)
def test_null_payload_and_duplicates_stay(spark, strategy):
    b = spark.createDataFrame([(1, "k", 5), (2, "k", None)], PRICE)
    a = spark.createDataFrame([(3, "k", 1), (3, "k", 1)], ORDER)
    assert [(r["time_right"], r["price"]) for r in asof_join(a, b, "stock", strategy=strategy).collect()] == [(2, None), (2, None)]


def test_product_beyond_64_bits(spark):
    b, a = spark.createDataFrame([(1, "k", 2**40)], PRICE), spark.createDataFrame([(1, "k", 2**40)], ORDER)
    assert int(asof_summary(asof_value(asof_join(a, b, "stock"))).first()["value_sum"]) == 2**80


def test_equal_times(spark):
    a = spark.createDataFrame([(1, "k", 1), (2, "k", 2)], "t long, k string, id long")
    b = spark.createDataFrame([(2, "k", 3), (2, "k", 4)], "rt long, k string, v long")
    assert [(r["id"], r["v"], r["rt"]) for r in asof_join(a, b, "k", "t", "rt", "equal").collect()] == [(2, 4, 2)]
    assert [r["id"] for r in asof_join(a, b.withColumnRenamed("rt", "t"), "k", "t", "t", "equal", how="anti").collect()] == [1]


def test_odd_names_and_bad_arguments(spark):
    a = spark.createDataFrame([(1, "x", 5)], "`a.t` long, k string, v long").withColumnRenamed("a.t", "t")
    b = spark.createDataFrame([(1, "x", 6)], "t long, k string, v long")
    assert asof_join(a, b, "k", "t", "t").columns == ["t", "k", "v", "t_right", "v_right"]
    for bad in ({"how": "cross"}, {"direction": "nearest"}, {"strategy": "magic"}):
        with pytest.raises(ValueError):
            asof_join(a, b, "k", "t", "t", **bad)


def test_costs_and_plan(spark):
    assert cost(1, 1_000_000)["probe_left"] < cost(1, 1_000_000)["fill"]
    assert cost(1_000_000, 1)["probe_right"] < cost(1_000_000, 1)["fill"]
    p, o = spark.createDataFrame(SMALL_PRICES, PRICE), spark.createDataFrame(SMALL_ORDERS, ORDER)
    plan = asof_join(o, p, "stock", strategy="fill")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Python" not in plan


def test_auto_finds_hot_keys(spark, monkeypatch):
    from timeweave.plans import chooser
    from timeweave.plans.base import T

    rows = spark.range(100).selectExpr("IF(id < 60, 'hot', CAST(id AS STRING)) AS __k0", f"id AS {T}")
    assert chooser.choose(rows, rows, ["__k0"], True) == "fill"
    monkeypatch.setattr(chooser, "HOT_BYTES", 0)
    monkeypatch.setattr(chooser, "HOT_ROWS", 120)
    assert chooser.largest_key(rows, rows, ["__k0"]) == 120
    assert chooser.choose(rows, rows, ["__k0"], True) == "bucketed" and chooser.choose(rows, rows, ["__k0"], False) == "fill"
    monkeypatch.setattr(chooser, "PROBE_BYTES", 0)
    assert chooser.choose(rows, rows.limit(1), ["__k0"], True) in ("probe_right", "fill", "bucketed")
    left, right = random_rows(10, 30, 30, ["a", "b"], 15)
    a = spark.createDataFrame(left, "id long, k string, t long")
    b = spark.createDataFrame(right, "rid long, k string, rt long, v long")
    out = asof_join(a, b, "k", "t", "rt", tie_break=["v", "rid"])
    assert sorted((tuple(r) for r in out.select("id", "rid").collect()), key=repr) == expected(left, right, "backward", True, "inner")
