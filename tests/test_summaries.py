"""Sketches, cubes of moments and the depth curves against exact and plain versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lobspark.functions import curves
from lobspark.operators import cube, sketches


def events(days=6, n=6000, seed=2):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"SecurityID": rng.choice(["a", "b"], n, p=[0.9, 0.1]), "date": rng.choice([f"d{k}" for k in range(days)], n), "x": np.round(rng.lognormal(3, 1, n), 2), "thing": rng.integers(0, 700, n)})
    rows.loc[::97, "x"] = np.nan
    return rows


def test_merged_sketches_keep_ranks_and_counts(spark):
    rows = events()
    daily = sketches.daily(spark.createDataFrame(rows), F.col("x"), F.col("thing"))
    assert daily.count() == 12
    got = sketches.thresholds(daily, [f"d{k}" for k in range(6)], 5).toPandas().set_index(["SecurityID", "date"])
    assert "d0" not in got.index.get_level_values(1)
    worst = 0.0
    for (stock, date), r in got.iterrows():
        k = int(date[1:])
        part = rows[(rows.SecurityID == stock) & rows.date.isin([f"d{j}" for j in range(max(0, k - 5), k)])]
        values = np.sort(part.x.dropna().to_numpy())
        assert r["n"] == len(values)
        below, upto = np.searchsorted(values, r["large_thresh"], "left") / len(values), np.searchsorted(values, r["large_thresh"], "right") / len(values)
        worst = max(worst, below - 0.9, 0.9 - upto)
        assert abs(r["distinct"] - part.thing.nunique()) <= 0.1 * part.thing.nunique()
    assert worst <= 2 * sketches.RANK_ERROR


def test_sketch_windows_and_empty_days(spark):
    assert sketches.before(["c", "a", "b", "a"], 2) == [("b", "a"), ("c", "a"), ("c", "b")]
    schema = "SecurityID string, date string, x double, thing long"
    daily = sketches.daily(spark.createDataFrame([("a", "d0", None, None), ("a", "d1", 2.0, 5), ("b", "d0", float("nan"), 1)], schema), F.col("x"), F.col("thing"))
    assert {(r["SecurityID"], r["date"], r["n"]) for r in daily.collect()} == {("a", "d0", 0), ("a", "d1", 1), ("b", "d0", 0)}
    got = sketches.thresholds(daily, ["d0", "d1", "d2"]).collect()
    assert [(r["SecurityID"], r["date"], r["n"], r["large_thresh"], r["distinct"]) for r in got] == [("a", "d2", 1, 2.0, 1)]
    assert sketches.thresholds(daily.limit(0), ["d0", "d1"]).count() == 0


def test_a_sketch_stays_small(spark):
    rows = spark.range(200_000).select(F.lit("a").alias("SecurityID"), F.lit("d").alias("date"), F.rand(3).alias("x"), F.col("id").alias("thing"))
    size = sketches.daily(rows, F.col("x"), F.col("thing")).select(F.octet_length("amounts") + F.octet_length("things")).first()[0]
    assert size < 12_000


def test_cube_against_every_group(spark):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"a": rng.choice(["p", "q"], 500), "b": rng.choice(["x", "y", "z"], 500), "v": rng.normal(1, 2, 500)})
    rows.loc[::50, "v"] = np.nan
    sets = [["a", "b"], ["b"], []]
    got = cube.cube(spark.createDataFrame(rows), F.col("v"), ["a", "b"], sets).toPandas()
    assert len(got) == 6 + 3 + 1
    for _, r in got.iterrows():
        part = rows[(rows.a == r["a"] if r["a"] else rows.a.notna()) & (rows.b == r["b"] if r["b"] else rows.b.notna())].v.dropna()
        assert r["level"] == 2 * (not r["a"]) + (not r["b"]) and r["n"] == len(part)
        z = (part - part.mean()) / part.std(ddof=0)
        want = [part.mean(), part.std(ddof=0), part.mean() / (part.std(ddof=0) + 1e-8), (part > 0).mean(), (z**3).mean(), (z**4).mean()]
        assert r[["mean", "std", "ratio", "win_rate", "skew", "kurtosis"]].astype(float).tolist() == pytest.approx(want)


def test_states_of_parts_add_up(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("day"), F.sin("id").alias("v"))
    whole = df.agg(*cube.states(F.col("v"))).select(*[c.alias(n) for n, c in cube.figures().items()]).first()
    parts = df.groupBy("day").agg(*cube.states(F.col("v"))).agg(*cube.merge()).select(*[c.alias(n) for n, c in cube.figures().items()]).first()
    assert list(whole) == pytest.approx(list(parts))
    none = df.limit(0).agg(*cube.states(F.col("v"))).select(*[c.alias(n) for n, c in cube.figures().items()]).first()
    assert none["mean"] is None and none["win_rate"] is None


def test_cube_sums_rows_once(spark):
    df = spark.range(10).select((F.col("id") % 2).cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"), F.col("id").cast("double").alias("v"))
    plan = cube.cube(df, F.col("v"), ["a", "b"], [["a", "b"], ["a"], []])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Expand") < plan.rindex("HashAggregate")  # rows are summed below the expansion (plans are printed from the top)


def book_rows(n=40, seed=6):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        r = {"SecurityID": "1", "date": "d", "timestamp": k, "mid_price": None if k % 11 == 0 else 10.0}
        for i in range(1, 11):
            for p, v in (("BidPrice", "BidVolume"), ("AskPrice", "AskVolume")):
                r[f"{p}{i}"] = rnd.choice([None, 0.0, float("nan"), 10.0 + i / 100, 10.0 - i / 100, 9.5])
                r[f"{v}{i}"] = rnd.choice([None, 0.0, 100.0, 250.0])
        rows.append(r)
    return rows


def test_depth_curves_against_a_loop(spark):
    rows = book_rows()
    schema = "SecurityID string, date string, timestamp int, mid_price double, " + ", ".join(f"{n}{i} double" for i in range(1, 11) for n in ("BidPrice", "BidVolume", "AskPrice", "AskVolume"))
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = {(r["timestamp"], r["side"], r["level"]): (r["price"], r["distance"], r["depth"], r["amount"], r["share"]) for r in curves.depth_curves(df).collect()}
    want = {}
    for r in rows:
        for side, p, v, sign in (("bid", "BidPrice", "BidVolume", -1), ("ask", "AskPrice", "AskVolume", 1)):
            levels = [(i, r[f"{p}{i}"], r[f"{v}{i}"] or 0.0) for i in range(1, 11) if r[f"{p}{i}"] and r[f"{p}{i}"] > 0]
            whole = sum(x[2] for x in levels)
            for k, (i, price, _) in enumerate(levels):
                depth = sum(x[2] for x in levels[: k + 1])
                away = sign * (price - r["mid_price"]) if r["mid_price"] else float("nan")
                want[r["timestamp"], side, i] = (price, away, depth, sum(x[1] * x[2] for x in levels[: k + 1]), depth / whole if whole else 0.0)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], nan_ok=True)
    curves.register(spark)
    df.createOrReplaceTempView("book_view")
    assert spark.sql("SELECT * FROM depth_curve(TABLE(SELECT SecurityID, date, timestamp, mid_price, " + ", ".join(f"{n}{i}" for n in ("BidPrice", "BidVolume", "AskPrice", "AskVolume") for i in range(1, 11)) + " FROM book_view))").count() == len(want)
    spark.catalog.dropTempView("book_view")
    assert curves.depth_curves(df.limit(0)).count() == 0
