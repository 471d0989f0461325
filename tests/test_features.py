"""Golden micro-cases, built by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lobspark.functions import timegrid
from lobspark.functions.windows import as_of
from lobspark.operators import evaluate, labels, orders, pca, trades
from lobspark.operators.registry import FEATURES, apply, feature
from lobspark.plans import factory

LEVELS = range(1, 11)


def book(spark, rows, **extra):
    """Rows of (stock, date, timestamp, bid1, ask1, bid volume, ask volume); other levels follow from the first."""
    out = []
    for r in rows:
        stock, date, ts, bid, ask, bv, av = r[:7]
        d = {"SecurityID": stock, "date": date, "timestamp": ts, "secs": float(ts)}
        for i in LEVELS:
            d |= {f"BidPrice{i}": None if bid is None else bid - 0.01 * (i - 1), f"AskPrice{i}": None if ask is None else ask + 0.01 * (i - 1), f"BidVolume{i}": bv, f"AskVolume{i}": av, f"NumOrdersB{i}": 1.0, f"NumOrdersS{i}": 1.0}
        d |= {"MaxBidDur": None, "MaxSellDur": None, "PreCloPrice": 10.0, "LastPrice": 10.0, "HighLimitPrice": None, "LowLimitPrice": None}
        out.append(d | {k: v for k, v in (r[7] if len(r) > 7 else {}).items()})
    names = list(out[0])
    kinds = {"SecurityID": "string", "date": "string", "timestamp": "int"}
    df = spark.createDataFrame([[d[n] for n in names] for d in out], ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names))
    return df.withColumn("mid_price", labels.mid_price())


def values(df, name):
    return [r[name] for r in df.orderBy("SecurityID", "date", "timestamp").collect()]


@pytest.mark.parametrize(("bid", "ask", "want"), [(10.01, 10.02, 50 + 300), (10.0, 10.02, (50 - 100) + 300), (9.99, 10.02, -100 + 300), (10.0, 10.03, -50 + 300), (10.0, 10.01, (50 - 100) - 80)])
def test_flow_by_branch(spark, bid, ask, want):
    df = book(spark, [("600001", "d1", 34200, 10.0, 10.02, 100.0, 300.0), ("600001", "d1", 34203, bid, ask, 50.0, 80.0)])
    e = 50 if bid > 10.0 else 50 - 100 if bid == 10.0 else -100
    f = -300 if ask > 10.02 else 80 - 300 if ask == 10.02 else 80
    assert values(apply(df, ["OFI_1"]), "OFI_1") == [0.0, pytest.approx((e - f) / 130)]


def test_a_day_starts_anew_and_order_of_rows_does_not_matter(spark):
    rows = [("600001", d, 34200 + 3 * k, 10.0 + 0.01 * k, 10.05, 100.0 + k, 90.0) for d in ("d1", "d2") for k in range(3)]
    a, b = apply(book(spark, rows), ["OFI", "RVol", "OFI_MA"]), apply(book(spark, rows[::-1]), ["OFI", "RVol", "OFI_MA"])
    assert values(a, "OFI") == values(b, "OFI")
    assert values(a, "OFI")[3] == 0.0
    assert values(a, "OFI_MA")[3] == 0.0


def test_decay_has_partial_sums_at_the_start(spark):
    got = values(apply(book(spark, [("600001", "d1", 34200 + 3 * k, 10.0 + 0.01 * k, 11.0, 100.0, 100.0) for k in range(5)]), ["OFI", "OFI_Decay"]), "OFI_Decay")
    assert all(x is not None for x in got)


def test_moving_average_and_moments_against_pandas(spark):
    rnd = np.random.default_rng(1)
    price = 10 + np.cumsum(rnd.integers(-1, 2, 400)) / 100
    rows = [("600001", "d1", 34200 + 3 * k, float(p), float(p) + 0.01, float(rnd.integers(1, 9)), float(rnd.integers(1, 9))) for k, p in enumerate(price)]
    df = apply(book(spark, rows), ["OFI", "OFI_MA", "RVol", "RSkew", "RKurt"]).orderBy("timestamp").toPandas()
    ema = df["OFI"].ewm(alpha=2 / 21, adjust=False).mean()
    assert np.allclose(df["OFI_MA"], ema)
    r = np.log(df["mid_price"]).diff().fillna(0)
    assert np.allclose(df["RVol"].dropna(), (r**2).rolling(300, min_periods=30).sum().dropna())
    assert df["RVol"].isna().sum() == 29
    n, s2, s3 = r.rolling(300, min_periods=30).count(), (r**2).rolling(300, min_periods=30).sum(), (r**3).rolling(300, min_periods=30).sum()
    ok = s2 > 1e-8
    assert np.allclose(df["RSkew"][ok & df["RSkew"].notna()], (np.sqrt(n) * s3 / s2**1.5)[ok & df["RSkew"].notna()])


def test_labels_break_at_gaps_lunch_and_close(spark):
    times = [34200 + 3 * k for k in range(6)] + [34260] + [41397, 41400, 46800, 46803, 46806, 46809, 53997, 54000, 54003, 54006, 54009, 54012]
    df = book(spark, [("600001", "d1", t, 10.0 + k / 100, 10.02 + k / 100, 1.0, 1.0) for k, t in enumerate(times)])
    got = dict(zip(times, values(labels.add_labels(df, {"r": 5}), "r"), strict=True))
    assert got[34200] == pytest.approx(math.log(10.06 / 10.01))
    assert got[34203] is None and got[41397] is None and got[53997] is None


def test_one_sided_and_empty_books(spark):
    df = book(spark, [("600001", "d1", 34200, None, 10.0, 0.0, 5.0), ("600001", "d1", 34203, None, None, 0.0, 0.0), ("600001", "d1", 34206, 10.0, 0.0, 5.0, 0.0)])
    names = [n for n, f in FEATURES.items() if f.source == "grid" and not f.helper]
    got = apply(df, names).orderBy("timestamp").collect()
    assert [r["mid_price"] for r in got] == [10.0, None, 10.0]
    assert got[0]["OBI"] == -1.0 and got[1]["OBI"] == 0.0 and got[1]["Spread"] is None and got[1]["BookSlope"] is None


@pytest.mark.parametrize(("stock", "native", "bid", "want"), [("600001", None, 11.0, 1), ("688001", None, 11.0, 0), ("688001", None, 12.0, 1), ("301001", None, 12.0, 1), ("000001", 10.5, 10.5, 1), ("000001", None, 10.99, 0)])
def test_limit_prices(spark, stock, native, bid, want):
    df = book(spark, [(stock, "d1", 34200, bid, None, 7.0, 0.0, {"HighLimitPrice": native, "LastPrice": bid}), (stock, "d1", 34203, bid, 0.0, 7.0, 0.0, {"HighLimitPrice": native, "LastPrice": bid}), (stock, "d1", 34206, bid, bid + 0.01, 7.0, 7.0, {"HighLimitPrice": native, "LastPrice": bid})])
    got = apply(df, ["IsLimitUp", "IsGapLimitUp", "LimitBlockAmt"]).orderBy("timestamp").collect()
    assert [r["IsLimitUp"] for r in got] == [want, want, 0] and got[1]["IsGapLimitUp"] == want
    assert got[0]["LimitBlockAmt"] == pytest.approx(want * 7 * bid)


def events(spark, rows):
    return spark.createDataFrame(rows, "SecurityID string, date string, secs double, TradPrice double, TradVolume double, TradeMoney double, TradeBSFlag string, TradeIndex long")


def test_tick_rule(spark):
    rows = [("000001", "d1", 34200.0 + k, p, 1.0, p, None, k) for k, p in enumerate([10.0, 10.0, 10.1, 10.1, 10.0, 10.0, 10.2])]
    got = [r["TradeBSFlag"] for r in trades.tick_rule(events(spark, rows)).orderBy("secs").collect()]
    assert got == list("BBBBSSB")


def test_as_of_takes_the_whole_last_book_and_equal_times(spark):
    grid = book(spark, [("600001", "d1", 34200, 10.0, 10.02, 1.0, 1.0), ("600001", "d1", 34203, 10.1, None, 1.0, 1.0)])
    t = events(spark, [("600001", "d1", s, 10.0, 1.0, 10.0, "B", k) for k, s in enumerate((34199.0, 34202.9, 34203.0, 34209.0))])
    got = as_of(t, grid, "secs", "secs", ["BidPrice1", "AskPrice1"]).orderBy("secs").collect()
    assert [(r["at_BidPrice1"], r["at_AskPrice1"]) for r in got] == [(None, None), (10.0, 10.02), (10.1, None), (10.1, None)]


def test_streaks_end_with_the_bucket(spark):
    rows = [("600001", "d1", s, 10.0, 1.0, 10.0, f, k) for k, (s, f) in enumerate([(34201.0, "B"), (34202.0, "B"), (34203.0, "S"), (34203.5, "S"), (34204.0, "S"), (34205.0, "B")])]
    t = events(spark, rows).withColumn("timestamp", timegrid.ceil_bucket(F.col("secs")))
    grid = book(spark, [("600001", "d1", 34200, 10.0, 10.02, 1.0, 1.0), ("600001", "d1", 34204, 10.0, 10.02, 1.0, 1.0)])
    got = trades.aggregate(t, grid).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["max_consec_buy"], r["max_consec_sell"]) for r in got] == [(34203, 2, 1), (34206, 1, 2)]


def test_large_trades_use_the_day_before(spark):
    rows = [("600001", d, 34201.0 + k / 100, 10.0, 1.0, float(m), "B", k) for d in ("d1", "d2") for k, m in enumerate(range(1, 9))]
    grid = book(spark, [("600001", d, 34200, 10.0, 10.02, 1.0, 1.0) for d in ("d1", "d2")])
    got = {r["date"]: r["trade_large_buy"] for r in trades.aggregate(events(spark, rows), grid).collect()}
    assert got == {"d1": 0.0, "d2": 7.0 + 8.0}


def test_orders_use_amounts_and_sides_without_orders_are_zero(spark):
    rows = [("600001", "d1", 34201.0, 10.0, 100.0, "B", "A", 1), ("600001", "d1", 34202.0, 5.0, 100.0, "B", "A", 2), ("600001", "d1", 34202.0, 0.0, 100.0, "B", "A", 3)]
    o = spark.createDataFrame(rows, "SecurityID string, date string, secs double, OrderPrice double, Balance double, OrderBSFlag string, OrderType string, OrderIndex long")
    grid = book(spark, [("600001", "d1", 34200, 10.0, 10.02, 1.0, 1.0), ("600001", "d1", 34203, 10.0, 10.02, 1.0, 1.0)])
    agg = orders.aggregate(o, grid).collect()[0]
    assert agg["new_buy_amt"] == 1500.0 and agg["depth_total_buy"] == 2 and agg["depth_total_sell"] == 0 and agg["market_order_cnt"] == 1
    got = factory.compute(grid, ["OrderDepthBestFrac", "OrderAggress", "MarketOrderFrac"], order_rows=o).orderBy("timestamp").collect()
    assert got[1]["OrderDepthBestFrac"] == 0.5 and got[1]["OrderAggress"] is None and got[1]["MarketOrderFrac"] == pytest.approx(1 / 3)


def test_constant_sections(spark):
    df = spark.createDataFrame([("d1", 34200, str(k), 5.0, float(k)) for k in range(10)], "date string, timestamp int, SecurityID string, x double, y double")
    assert {r["x"] for r in evaluate.standardise(df, ["x"]).collect()} == {0.0}
    assert evaluate.rank_ic(df, "x", "y").count() == 0


def test_rank_correlation_with_ties_and_nulls(spark):
    rows = [("d1", 34200, str(k), float(x), y) for k, (x, y) in enumerate(zip((1, 2, 3, 4, 9), (3.0, 3.0, 1.0, 7.0, None), strict=True))]
    df = spark.createDataFrame(rows, "date string, timestamp int, SecurityID string, x double, y double")
    got = evaluate.rank_ic(df, "x", "y", min_stocks=4).collect()[0]
    assert got["n_stocks"] == 4 and got["rank_ic"] == pytest.approx(0.31622776601683794)


def test_summary_without_sections_is_null(spark):
    df = spark.createDataFrame([], "date string, timestamp int, n_stocks long, rank_ic double")
    row = evaluate.summarise(df).collect()[0]
    assert row["mean_ic"] is None and row["n_buckets"] == 0


def test_pca_against_numpy(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(30, 3)) @ rnd.normal(size=(3, 3))
    df = spark.createDataFrame([("d1", 34200, str(k), *map(float, r)) for k, r in enumerate(x)] + [("d1", 34200, "none", None, 1.0, 1.0)] + [("d1", 34203, "few", 1.0, 1.0, 1.0)], "date string, timestamp int, SecurityID string, OFI_1 double, OFI double, OFI_10 double")
    got = pca.add_pca(df).toPandas().set_index("SecurityID")
    z = (x - x.mean(0)) / x.std(0)
    w, v = np.linalg.eigh(z.T @ z / 29)
    v = v[:, -1] * (1 if v[1, -1] >= 0 else -1)
    assert np.allclose(got.loc[[str(k) for k in range(30)], "OFI_PC1"], z @ v)
    assert np.allclose(got.loc["0", "OFI_PC1_Var"], w[-1] / w.sum())
    assert pd.isna(got.loc["none", "OFI_PC1"]) and pd.isna(got.loc["few", "OFI_PC1"])


def test_missing_columns_and_unknown_features(spark):
    df = spark.createDataFrame([("1", "d", 1)], "SecurityID string, date string, timestamp int")
    with pytest.raises(KeyError, match="BidVolume1"):
        apply(df, ["OBI"])
    with pytest.raises(KeyError, match="unknown"):
        factory.compute(df, ["nothing"])


def test_own_features_can_be_registered(spark):

    feature("TwiceOBI", needs=["OBI"])(lambda: F.col("OBI") * 2)
    try:
        df = book(spark, [("600001", "d1", 34200, 10.0, 10.02, 3.0, 1.0)])
        assert values(apply(df, ["TwiceOBI"]), "TwiceOBI") == [1.0]
        with pytest.raises(ValueError):
            feature("TwiceOBI")(lambda: F.lit(0))
    finally:
        del FEATURES["TwiceOBI"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(990, 1010)), min_size=1, max_size=6))
def test_imbalances_are_bounded_and_flip_with_the_sides(spark, rows):
    names = ["OBI", "OBI_5", "AmtOBI_5", "OCIB_5", "OFI_1", "TS_Imbalance"]
    make = lambda flip: apply(book(spark, [("600001", "d1", 34200 + 3 * k, p / 100, p / 100 + 0.01, float(a if flip else b), float(b if flip else a)) for k, (a, b, p) in enumerate(rows)]), names)
    one, two = make(False).orderBy("timestamp").collect(), make(True).orderBy("timestamp").collect()
    for a, b in zip(one, two, strict=True):
        assert all(-1 <= a[n] <= 1 for n in names if n not in ("OFI_1",))
        assert a["OBI"] == -b["OBI"] and a["OBI_5"] == -b["OBI_5"]
    assert len(one) == len(rows)


def test_one_window_for_all_stock_features(spark):
    df = book(spark, [("600001", "d1", 34200, 10.0, 10.02, 3.0, 1.0)])
    plan = apply(df, ["OFI", "OFI_10", "TS_Imbalance", "OFI_MA", "OFI_Z", "OFI_Decay", "RVol", "RKurt"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("+- Sort [") + plan.count("Sort [Sec") <= 2


@pytest.mark.parametrize("jump", [0.02, 0.4])
def test_rolling_sums_lose_nothing_to_a_jump_that_has_left(spark, jump):

    from lobspark.functions.windows import largest, rolling

    rng = np.random.default_rng(3)
    r = rng.normal(size=4800) * 1e-4
    r[100], r[[7, 2000]] = jump, np.nan
    rows = [("600000", "20240102", k, None if np.isnan(x) else float(x)) for k, x in enumerate(r)]
    df = spark.createDataFrame(rows, "SecurityID string, date string, timestamp int, r double").withColumn("s", largest(F.col("r")))
    share = F.col("r") / F.col("s")
    powers = {2: share * share, 3: share * share * share, 4: (share * share) * (share * share)}
    got = df.select("timestamp", *[(rolling(x, 300) * F.pow("s", F.lit(k))).alias(f"p{k}") for k, x in powers.items()]).toPandas().sort_values("timestamp")
    for k in powers:
        want = np.array([math.fsum(x**k for x in r[max(0, i - 299) : i + 1] if x == x) for i in range(len(r))])
        scale = np.array([math.fsum(abs(x) ** k for x in r[max(0, i - 299) : i + 1] if x == x) for i in range(len(r))])
        assert (np.abs(got[f"p{k}"] - want) <= 1e-12 * scale).all()
