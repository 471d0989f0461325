import pytest
from pyspark.sql import functions as F

from lobspark.__main__ import main
from lobspark.operators import model
from lobspark.plans.factory import Factory, run_day, run_range
from lobspark.sources.market import MarketData
from lobspark.sources.store import FeatureStore

DATES = ["20240102", "20240103", "20240104", "20240105", "20240108", "20240109"]
LEVELS = range(1, 11)


def clock(secs, ms=0):
    return f"{secs // 3600:02d}:{secs // 60 % 60:02d}:{secs % 60:02d}.{ms:03d}"


def snap(stock, k, sz, day):
    secs = 34200 + 3 * k
    row = {"UpdateTime": clock(secs, 500), "SecurityID": stock, "PreCloPrice": 10.0, "OpenPrice": 10.0, "HighPrice": 10.0, "LowPrice": 10.0, "LastPrice": 10.0, "Turnover": 1.0}
    base = 10 + ((k * k + 3 * int(stock) + day) % 7) / 100
    for i in LEVELS:
        row |= {f"BidPrice{i}": base - i / 100, f"AskPrice{i}": base + i / 100, f"BidVolume{i}": float((k + i + int(stock)) % 7 * 100), f"AskVolume{i}": float((k * 3 + i) % 5 * 100), f"NumOrdersB{i}": i, f"NumOrdersS{i}": i + 1}
    if sz:
        return row | {"HighLimitPrice": 11.0, "LowLimitPrice": 9.0, "TradingPhaseCode": "T", "TotalBidQty": 1.0, "TotalOfferQty": 2.0, "TurnNum": 3.0, "Volume": 4.0}
    return row | {"MaxBidDur": 5, "MaxSellDur": 6, "TotBidNum": 1, "TotSellNum": 1, "TradNumber": 1, "TotalBidVol": 1.0, "TotalAskVol": 2.0, "TradVolume": 4.0}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    import pandas as pd

    top = tmp_path_factory.mktemp("market")
    for day, date in enumerate(DATES):
        tables = {
            "snap_sh": [snap(f"60000{s}", k, False, day) for s in range(6) for k in range(12)] + [snap("600000", 3, False, day) | {"UpdateTime": clock(34209 + 1, 999), "LastPrice": 12.0}, snap("600000", 0, False, day) | {"UpdateTime": "09:29:59.000"}, snap("600000", 0, False, day) | {"UpdateTime": "15:00:00.001"}],
            "snap_sz": [snap(f"00000{s}", k, True, day) for s in range(6) for k in range(12)],
            "trade_sh": [{"SecurityID": "600000", "TradTime": clock(34201 + k), "TradPrice": 10.0, "TradVolume": 100.0, "TradeMoney": 1000.0 + k, "TradeBSFlag": "BS"[k % 2], "TradeIndex": k, "LocalTime": ""} for k in range(9)],
            "trade_sz": [{"SecurityID": "000000", "TransactTime": clock(34201 + k), "LastPx": 10.0 + k / 100, "LastQty": 100, "ApplSeqNum": k, "ExecType": 52 if k == 3 else 70, "LocalTime": ""} for k in range(9)],
            "order_sh": [{"SecurityID": "600000", "OrderTime": clock(34201 + k), "OrderPrice": 9.99, "Balance": 100.0, "OrderBSFlag": "BS"[k % 2], "OrderType": "AD"[k % 3 == 0], "OrderIndex": k} for k in range(9)],
            "order_sz": [{"SecurityID": "000000", "TransactTime": clock(34201 + k), "Price": 9.99, "OrderQty": 100, "Side": 49 + k % 2, "OrdType": (49, 50, 85)[k % 3], "ApplSeqNum": k} for k in range(9)],
        }
        for kind, rows in tables.items():
            folder = top / f"type={kind}" / f"date={date}"
            folder.mkdir(parents=True)
            pd.DataFrame(rows).to_parquet(folder / "data.parquet")
    return str(top)


def test_snapshots_are_unified_and_the_last_of_a_bucket_stays(spark, root):
    df = MarketData(spark, root).snapshots(["HighLimitPrice", "MaxBidDur", "LastPrice", "TotalBidVol"])
    assert df.count() == len(DATES) * 12 * 12
    row = df.where("SecurityID = '600000' AND timestamp = 34209 AND date = '20240102'").collect()
    assert len(row) == 1 and row[0]["LastPrice"] == 12.0 and row[0]["secs"] == pytest.approx(34210.999)
    assert df.where("SecurityID LIKE '00%' AND MaxBidDur IS NOT NULL").isEmpty() and df.where("SecurityID LIKE '60%' AND HighLimitPrice IS NOT NULL").isEmpty()
    assert df.where("TotalBidVol IS NULL").isEmpty()
    assert dict(df.dtypes)["MaxBidDur"] == "double" and dict(df.dtypes)["timestamp"] == "int"


def test_columns_and_dates_are_pruned(spark, root):
    df = MarketData(spark, root).market_snapshots("sh", ["LastPrice"]).where("date = '20240103'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan or "date#" in plan.split("PartitionFilters")[1][:200]
    assert "BidPrice7" not in plan and "PushedFilters: [IsNotNull(UpdateTime)" in plan


def test_missing_markets(spark, root, tmp_path):
    with pytest.raises(FileNotFoundError):
        MarketData(spark, str(tmp_path)).market_snapshots("sh")
    with pytest.raises(RuntimeError):
        MarketData(spark, str(tmp_path)).snapshots()
    (tmp_path / "type=trade_sh").symlink_to(f"{root}/type=trade_sh")
    assert MarketData(spark, str(tmp_path)).trades().count() == 9 * len(DATES)


def test_ticks_are_normalised(spark, root):
    t = MarketData(spark, root).trades().where("date = '20240102'").toPandas()
    assert len(t) == 9 + 8 and t.loc[t.SecurityID == "000000", "TradeBSFlag"].isna().all()
    assert t.loc[t.SecurityID == "000000", "TradeMoney"].iloc[0] == pytest.approx(1000.0)
    o = MarketData(spark, root).orders().where("date = '20240102' AND SecurityID = '000000'").toPandas()
    assert set(o.OrderType) == {"A", "D"} and len(o) == 6 and set(o.OrderBSFlag) == {"B", "S"}


def test_dates(spark, root, tmp_path):
    data = MarketData(spark, root)
    assert data.dates() == DATES and data.dates("20240103", "20240105") == DATES[1:4]
    assert MarketData(spark, str(tmp_path)).dates() == []


def test_a_day_with_all_features_and_the_store(spark, root, tmp_path):
    names = ["OBI", "OFI", "TradeImb", "LargeTradeRatio", "OrderImb", "IsLimitUp", "RVol"]
    store = FeatureStore(spark, str(tmp_path / "store"))
    factory = Factory(MarketData(spark, root), store)
    first = run_day(factory, DATES[1], names)
    assert first["rows"] == 144 and first["stocks"] == 12
    assert store.exists("OBI", DATES[1]) and not store.exists("OBI", DATES[2]) and not store.exists("Spread")
    again = factory.compute([DATES[1]], names)
    key = ["SecurityID", "timestamp"]
    a, b = (d.select(*key, *names).toPandas().sort_values(key).reset_index(drop=True) for d in (first["df"], again))
    assert a[names].fillna(-9).astype(float).equals(b[names].fillna(-9).astype(float))
    assert first["df"].where("SecurityID = '600000' AND LargeTradeRatio <> 0").count() > 0  # thresholds of the day before
    other = FeatureStore(spark, str(tmp_path / "store"), universe="few")
    assert not other.exists("OBI")
    with pytest.raises(FileNotFoundError):
        other.read("OBI")


def test_all_75_features_of_a_day(spark, root):
    got = Factory(MarketData(spark, root)).compute([DATES[1]])
    assert got.count() == 144 and len([c for c in got.columns if c in ("OFI_PC1", "TradeIntensityZ", "OrderAggress")]) == 3


def test_walk_forward_needs_five_dates():
    assert model.walk_forward(DATES[:4]) == []
    fold = model.walk_forward(DATES)[0]
    assert fold.test == DATES[4:] and set(fold.train).isdisjoint(fold.validate)
    dates = [f"{d:08d}" for d in range(114)]
    fold = model.walk_forward(dates)[0]
    assert (len(fold.train), len(fold.validate), len(fold.test)) == (59, 22, 23)
    assert int(fold.validate[0]) - int(fold.train[-1]) == 6 and int(fold.test[0]) - int(fold.validate[-1]) == 6


def test_folds_test_no_day_twice_and_keep_their_gaps():
    for days in range(5, 130, 7):
        dates = [f"{d:08d}" for d in range(days)]
        for folds in (1, 2, 4):
            found = model.walk_forward(dates, folds)
            tested = [d for f in found for d in f.test]
            assert tested == sorted(set(tested)) and (folds > 1 or tested[-1:] == dates[-1:])
            for f in found:
                gap = min(5, max(1, days // 20))
                assert int(f.validate[0]) - int(f.train[-1]) == int(f.test[0]) - int(f.validate[-1]) == gap + 1
                assert len(f.validate) == int(days * 0.2) and f.train[0] == dates[0]


def test_range_trains_and_scores(spark, root):
    got = run_range(Factory(MarketData(spark, root)), DATES[0], DATES[-1], names=["OBI", "OFI"], rounds=2, least=5, l1=0.0)
    rows = {r["horizon"]: r for r in got[0].collect()}
    assert rows["ret_15s"]["n_buckets"] > 0
    with pytest.raises(SystemExit):
        run_range(Factory(MarketData(spark, root)), DATES[0], DATES[1], names=["OBI"])


def test_model_guards(spark):
    m = model.AlphaModel(["x"])
    df = spark.createDataFrame([("1", "d", 1, 1.0)], "SecurityID string, date string, timestamp int, x double")
    with pytest.raises(RuntimeError):
        m.predict(df)
    with pytest.raises(RuntimeError):
        m.importance()
    with pytest.raises(KeyError, match="stock_id"):
        m.prepare(df, labelled=False)
    assert [r["stock_id"] for r in model.add_stock_id(spark.createDataFrame([("b",), ("a",)], "SecurityID string")).orderBy(F.col("SecurityID")).collect()] == [0, 1]


def test_command_line(root, capsys):
    main([root, "--date", DATES[1], "--features", "OBI", "Spread", "--no-cache"])
    assert "144 rows, 12 stocks, 2 features" in capsys.readouterr().out


def test_dates_come_from_the_listing(spark, root, monkeypatch):
    data = MarketData(spark, root)
    monkeypatch.setattr(MarketData, "_schema", lambda *_: pytest.fail("a file was opened"))
    assert data.dates() == DATES


def test_columns_that_change_from_day_to_day(spark, tmp_path):
    rows = [("09:30:00.000", "600000", 1)]
    days = {"20240102": ("a int, b float, c int, d smallint, gone string", (1, 1.5, 7, 1, "x")), "20240103": ("a long, b double, c string, d int, new double", (1 << 40, 2.5, "8", 2, 3.0)), "20240104": ("a int, b float, c int, d smallint, gone string", (2, 0.5, 9, 3, None))}
    for date, (schema, row) in days.items():
        spark.createDataFrame([(*rows[0][:2], *row)], f"UpdateTime string, SecurityID string, {schema}").write.parquet(f"{tmp_path}/type=snap_sh/date={date}")
    (tmp_path / "type=snap_sh" / "date=20240105").mkdir()  # a day without files
    data = MarketData(spark, str(tmp_path))
    df = data._scan("snap", "sh")
    assert {k: v for k, v in df.dtypes if len(k) == 1} == {"a": "bigint", "b": "double", "c": "string", "d": "int"} or dict(df.dtypes)["d"] == "bigint"
    got = {r["date"]: (r["a"], r["b"], r["c"], r["d"], r["gone"], r["new"]) for r in df.collect()}
    assert got == {"20240102": (1, 1.5, "7", 1, "x", None), "20240103": (1 << 40, 2.5, "8", 2, None, 3.0), "20240104": (2, 0.5, "9", 3, None, None)}
    files = df.where("date = '20240103'").select("a").inputFiles()
    assert files and data._scan("snap", "sh") is df
    plan = df.where("date = '20240103'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(date") == 2  # a scan for each of the two schemas


def test_wider_types():
    from pyspark.sql import types as t

    from lobspark.sources.market import wider

    assert wider(t.IntegerType(), t.LongType()) == t.LongType() and wider(t.IntegerType(), t.FloatType()) == t.DoubleType()
    assert wider(t.FloatType(), t.FloatType()) == t.FloatType() and wider(t.StringType(), t.IntegerType()) == t.StringType()


def test_second_action_reads_no_tick_file(spark, root):
    factory = Factory(MarketData(spark, root))
    first = factory.compute(DATES[1:3], ["TradeImb", "OrderImb"])
    files = first.inputFiles()
    assert not [f for f in files if "type=trade" in f or "type=order" in f] and [f for f in files if "type=snap" in f]
    made = dict(factory.made)
    again = factory.compute([DATES[2]], ["LargeTradeRatio", "CancelRateImb"])
    assert factory.made == made and len(made) == 2 and not [f for f in again.inputFiles() if "type=trade" in f]
    from lobspark.operators import orders, trades
    from lobspark.plans import factory as plans

    data = MarketData(spark, root)
    days = DATES[1:3]
    grid = factory.grid(["TradeImb", "OrderImb"], DATES[2:3])
    ticks = lambda rows: rows.where(F.col("date").isin(days))
    plain = plans.compute(grid, ["LargeTradeRatio", "CancelRateImb"], ticks(data.trades()), ticks(data.orders()))
    key = ["SecurityID", "timestamp", "LargeTradeRatio", "CancelRateImb"]
    a, b = (sorted(map(tuple, d.select(*key).collect()), key=str) for d in (again, plain))
    assert a == b and any(r[2] for r in a)
    factory.forget()
    assert not factory.made and trades and orders


def test_store_sets(spark, tmp_path):
    """Features written together and apart, a day written again, and versions that have changed."""
    store = FeatureStore(spark, str(tmp_path))
    schema = "date string, timestamp int, SecurityID string, x double, y double, z double"
    rows = lambda d, k: [(d, t, s, float(k + t), None if t == 1 else 2.0 * k, 0.5) for t in (1, 2) for s in ("a", "b")]
    store.write(spark.createDataFrame(rows("d1", 1) + rows("d2", 2), schema), "x", "y")
    store.write(spark.createDataFrame(rows("d1", 3), schema), "z")
    assert store.held() == {("x", "d1"), ("x", "d2"), ("y", "d1"), ("y", "d2"), ("z", "d1")}
    keys = spark.createDataFrame([(d, t, s, 7) for d in ("d1", "d2", "d3") for t in (1, 2) for s in ("a", "b")], "date string, timestamp int, SecurityID string, own int")
    got = {(r["date"], r["timestamp"], r["SecurityID"]): (r["x"], r["y"], r["z"], r["own"]) for r in store.join(keys, "x", "y", "z").collect()}
    assert got["d1", 1, "a"] == (2.0, None, 0.5, 7) and got["d2", 2, "b"] == (4.0, 4.0, None, 7) and got["d3", 1, "a"] == (None, None, None, 7)
    store.write(spark.createDataFrame(rows("d2", 10), schema), "x")  # in a set of its own
    got = {(r["date"], r["timestamp"], r["SecurityID"]): (r["x"], r["y"]) for r in store.join(keys, "x", "y").collect()}
    assert got["d1", 2, "a"] == (3.0, 2.0) and got["d2", 2, "a"] == (12.0, 4.0)
    assert store.read("x").count() == 8 and store.read("y").count() == 4
    plan = store.join(keys, "x")._jdf.queryExecution().executedPlan().toString()
    assert "y@" not in plan and "Aggregate" not in plan  # columns are pruned, nothing is pivoted
    store.version = lambda name: "changed"
    assert store.held() == set()
