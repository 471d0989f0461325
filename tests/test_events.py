"""Streaming as-of joins, bursts, sliding windows and theta joins against plain versions."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lobspark.functions.windows import as_of
from lobspark.operators import bursts, overlap
from lobspark.streaming import asof

DAY = dt.datetime(2024, 1, 2, 9, 30)
BOOK = "SecurityID string, date string, ts timestamp, bid double, ask double"
TRADE = "SecurityID string, date string, ts timestamp, price double, side string, no long"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(asof.STATE_STORE[0])
    spark.conf.set(*asof.STATE_STORE)
    yield
    spark.conf.set(asof.STATE_STORE[0], before)


def replayed(spark, folder, rows, schema, files):
    """Rows as files in the order of their time less up to 40 seconds, a file a batch."""
    for k, part in enumerate(files(rows)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/f{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*")


def run(df, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def shuffled(many, seed):
    rnd = random.Random(seed)

    def files(rows):
        order = sorted(rows, key=lambda r: r[2] - dt.timedelta(seconds=rnd.random() * 40))
        return [order[k * len(order) // many : (k + 1) * len(order) // many] for k in range(many)]

    return files


def market(seed, n=160):
    rnd = random.Random(seed)
    at = lambda: DAY + dt.timedelta(milliseconds=rnd.randrange(400_000))
    stocks = ["600000", "000001", "300002"]
    times = sorted({(s, at()) for s in stocks for _ in range(n // 2)})
    book = [(s, "20240102", t, None if rnd.random() < 0.1 else rnd.randrange(100) / 10, rnd.randrange(100) / 10) for s, t in times]
    trades = [(rnd.choice(stocks), "20240102", at(), rnd.randrange(100) / 10, rnd.choice(["B", "S", None]), k) for k in range(n)]
    trades += [(b[0], b[1], b[2], 1.0, "B", 1000 + k) for k, b in enumerate(book[::9])]  # at the very time of a book row
    return book, trades


def test_streams_join_as_tables_do(spark, rocks, tmp_path):
    book, trades = market(1)
    end = DAY + dt.timedelta(hours=1)
    tail = lambda row: lambda rows: [*shuffled(4, 2)(rows), [row]]
    b = replayed(spark, tmp_path / "book", book, BOOK, tail(("end", "20240102", end, None, None)))
    t = replayed(spark, tmp_path / "trades", trades, TRADE, tail(("end", "20240102", end, None, None, -1)))
    got = run(asof.stream_as_of(t, b, ["bid", "ask"], ["price", "side", "no"]), "as_of_stream", spark).where("no >= 0").toPandas()
    secs = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("secs", F.unix_micros("ts") / 1e6)
    want = as_of(secs(trades, TRADE), secs(book, BOOK), "secs", "secs", ["bid", "ask"]).toPandas()
    columns = ["no", "SecurityID", "ts", "price", "side", "at_bid", "at_ask"]
    plain = lambda f: f[columns].sort_values("no").astype(object).where(f[columns].sort_values("no").notna(), None).to_numpy().tolist()
    assert len(got) == len(trades) and plain(got) == plain(want)


def test_trades_later_than_the_watermark_are_left_out(spark, rocks, tmp_path):
    at = lambda s: DAY + dt.timedelta(seconds=s)
    b = replayed(spark, tmp_path / "book", [("1", "d", at(0), 1.0, 2.0), ("1", "d", at(600), 3.0, 4.0), ("1", "d", at(7200), 5.0, 6.0), ("1", "d", at(9000), 5.0, 6.0)], BOOK, lambda rows: [[r] for r in rows])
    rows = [("1", "d", at(5), 1.0, "B", 1), ("1", "d", at(600), 1.0, "B", 2), ("1", "d", at(7200), 1.0, "B", 3), ("1", "d", at(10), 1.0, "B", 4), ("1", "d", at(9000), 1.0, "B", 5)]
    t = replayed(spark, tmp_path / "trades", rows, TRADE, lambda rows: [[r] for r in rows])
    got = run(asof.stream_as_of(t, b, ["bid"], ["no"]), "late_stream", spark).toPandas().set_index("no")["at_bid"].to_dict()
    assert got == {1: 1.0, 2: 3.0, 3: 5.0}  # the fourth is late, the fifth waits for the watermark


def test_state_is_what_the_delay_spans():
    """A key's book state after each watermark: the latest row before it, and later ones."""

    class Fake:
        def __init__(self):
            self.rows = []

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def appendList(self, rows):  # noqa: N802
            self.rows += rows

        def clear(self):
            self.rows = []

        def exists(self):
            return bool(self.rows)

        def update(self, row):
            self.rows = list(row)

    class Values:
        mark = 0

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.mark

    class Handle:
        def getListState(self, *_):  # noqa: N802
            return Fake()

        def getValueState(self, *_):  # noqa: N802
            v = Fake()
            v.get = lambda: v.rows
            return v

        def registerTimer(self, _):  # noqa: N802
            pass

    from pyspark.sql.types import DoubleType, LongType, StructField

    p, values = asof._AsOf([StructField("bid", DoubleType()), StructField("no", LongType())], ["no"], ["bid"]), Values()
    p.init(Handle())
    sizes, answers = [], []
    for k in range(50):
        at = pd.Timestamp(DAY) + pd.Timedelta(seconds=10 * k)
        frame = pd.DataFrame({"ts": [at, at], "stream_side": [0, 1], "bid": [float(k), None], "no": [None, k]})
        found = list(p.handleInputRows(("1", "d"), iter([frame]), values))
        values.mark = int(at.value // 1_000_000) - 30_000
        if k % 5 == 4:  # else with the next rows
            found += p.handleExpiredTimer(("1", "d"), values, None)
        answers += [x for f in found for x in zip(f["no"], f["at_bid"], strict=True)]
        sizes.append((len(p.book.rows), len(p.waiting.rows)))
    assert max(sizes) <= (7, 6) and answers == [(k, float(k)) for k in range(46)]


def trade_rows(seed=3, n=400):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        t = DAY + dt.timedelta(milliseconds=rnd.choice([rnd.randrange(120_000), 10_000 * rnd.randrange(12), 2000 * rnd.randrange(60)]))
        rows.append((rnd.choice(["1", "2"]), rnd.choice(["d1", "d2"]), t, rnd.randrange(1, 9) / 2, rnd.randrange(1, 5) * 100.0, rnd.choice(["B", "S", None])))
    return rows, "SecurityID string, date string, ts timestamp, TradPrice double, TradVolume double, TradeBSFlag string"


def test_bursts_against_a_loop(spark):
    rows, schema = trade_rows()
    df = spark.createDataFrame([*rows, ("1", "d1", None, 1.0, 1.0, "B")], schema).withColumn("TradeMoney", F.col("TradPrice") * F.col("TradVolume"))
    got = sorted((r["SecurityID"], r["date"], r["opens"], r["closes"], r["trade_count"], r["volume"], r["buy_money"], r["low"]) for r in bursts.bursts(df, "1500 milliseconds").collect())
    want = []
    for key in sorted({r[:2] for r in rows}):
        held = []
        for r in [*sorted((r for r in rows if r[:2] == key), key=lambda r: r[2]), None]:
            if held and (r is None or r[2] - held[-1][2] > dt.timedelta(seconds=1.5)):
                want.append((*key, held[0][2], held[-1][2], len(held), sum(x[4] for x in held), sum(x[3] * x[4] for x in held if x[5] == "B"), min(x[3] for x in held)))
                held = []
            held.append(r)
    assert got == sorted(want) and len({w[4] for w in want}) > 3


def test_sliding_flow_against_a_loop(spark):
    rows, schema = trade_rows(5)
    df = spark.createDataFrame(rows, schema).withColumn("TradeMoney", F.col("TradPrice") * F.col("TradVolume"))
    got = {(r["SecurityID"], r["date"], r["window_end"]): (r["trade_count"], r["volume"], r["high"]) for r in bursts.sliding_flow(df).collect()}
    want = {}
    for k in range(0, 16):
        end = DAY + dt.timedelta(seconds=10 * k)
        for key in {r[:2] for r in rows}:
            held = [r for r in rows if r[:2] == key and end - dt.timedelta(seconds=30) < r[2] <= end]
            if held:
                want[*key, end] = (len(held), sum(r[4] for r in held), max(r[3] for r in held))
    assert got == want


def test_bursts_of_a_stream_with_late_trades(spark, tmp_path):
    at = lambda s: DAY + dt.timedelta(seconds=s)
    rows = [("1", "d", at(s), 10.0, 100.0, "B") for s in (0, 1, 2.5, 30, 31, 1.8, 90, 95, 2.0, 200, 201)]
    src = replayed(spark, tmp_path, rows, trade_rows()[1], lambda r: [r[:3], r[3:6], r[6:7], r[7:8], r[8:9], r[9:10], r[10:]]).withColumn("TradeMoney", F.lit(1.0))
    got = sorted((r["opens"], r["closes"], r["trade_count"]) for r in run(bursts.bursts(src, late="60 seconds"), "burst_stream", spark).collect())
    # the trade at 1.8 is 29 seconds late and counts, the one at 2.0 comes after the watermark has reached 30
    assert got == [(at(0), at(2.5), 4), (at(30), at(31), 2), (at(90), at(90), 1), (at(95), at(95), 1)]


def spans(seed, n, keys=("a", "b"), wide=60.0):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        begin = rnd.choice([rnd.random() * 100, float(rnd.randrange(100))])
        length = rnd.choice([0.0, 0.25, 1.0, rnd.random() * 4, rnd.random() * wide, 300.0 if k % 17 == 0 else 2.0])
        out.append((rnd.choice(keys), k, begin, None if k % 23 == 5 else begin + length))
    return out


@pytest.mark.parametrize(("width", "part"), [(1.0, 2000), (0.5, 3), (16.0, 10), (1000.0, 7)])
def test_overlaps_against_all_pairs(spark, width, part):
    a, b = spans(1, 120), spans(2, 150)
    left, right = spark.createDataFrame(a, "k string, x long, b double, e double"), spark.createDataFrame(b, "k string, y long, b2 double, e2 double")
    got = [(r["x"], r["y"]) for r in overlap.overlapping(left, right, ["k"], (F.col("b"), F.col("e")), (F.col("b2"), F.col("e2")), width, part).collect()]
    want = [(p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[3] is not None and q[3] is not None and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3]]
    assert sorted(got) == sorted(want) and len(got) == len(set(got)) > 500


@pytest.mark.parametrize(("width", "part"), [(2.0, 2000), (0.3, 4), (50.0, 5)])
def test_band_against_all_pairs(spark, width, part):
    a, b = spans(3, 130), [(k, y, at) for k, y, at, _ in spans(4, 200)] + [("a", 999, None), (None, 5, 3.0)]
    left, right = spark.createDataFrame(a, "k string, x long, b double, e double"), spark.createDataFrame(b, "k string, y long, at double")
    got = [(r["x"], r["y"]) for r in overlap.in_band(left, right, ["k"], F.col("b"), F.col("e"), F.col("at"), width, part).collect()]
    want = [(p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[3] is not None and q[2] is not None and p[2] <= q[2] <= p[3]]
    assert sorted(got) == sorted(want) and len(got) > 500
    plan = overlap.in_band(left, right, ["k"], F.col("b"), F.col("e"), F.col("at"), width, part)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_hot_bins_are_dealt_out(spark):
    """A third of all rows in one bin: parts of it hold no more than they should, and nothing is lost."""
    right = spark.createDataFrame([("a", y, 5.0 if y % 3 else 100.0 + y) for y in range(900)], "k string, y long, at double")
    left = spark.createDataFrame([("a", x, 4.5, 5.5) for x in range(5)], "k string, x long, b double, e double")
    a, b = overlap._parted(left.withColumn("n", F.lit(5)), right.withColumn("n", F.floor("at").cast("int")), ["k", "n"], 50, "__bin")
    sizes = [r["count"] for r in b.where("n = 5").groupBy("__binpart").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 90 and a.count() == 5 * 12
    assert overlap.in_band(left, right, ["k"], F.col("b"), F.col("e"), F.col("at"), 1.0, 50).count() == 5 * 600
    with pytest.raises(ValueError, match="both sides"):
        overlap.in_band(left, right.withColumnRenamed("y", "x"), ["k"], F.col("b"), F.col("e"), F.col("at"), 1.0)
