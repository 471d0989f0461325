"""Queries of events in time, sketches, cubes and table functions, with SQL; registered with those of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves
from ..operators import bursts, cube, overlap, sketches
from ..operators.trades import tick_rule
from ..sources import adapters, scratch
from ..streaming import asof
from .catalog import _FLOWS, _HORIZONS, _T, _T_SEEN, KEYS, S, _figures, _predicted, _ret, _sections, _with, on_grid, q, query

_FLOW = "count(*) as trade_count, sum(TradVolume) as volume, sum(TradeMoney) as money, coalesce(sum(TradeMoney) filter (side = 'B'), 0) as buy_money, coalesce(sum(TradeMoney) filter (side = 'S'), 0) as sell_money, count(*) filter (side = 'B') as buy_count, min(TradPrice) as low, max(TradPrice) as high"
_FLOW_NAMES = ["volume", "money", "buy_money", "sell_money", "low", "high"]
_BURSTS = (
    *_T,
    "bt as (select *, case when secs - lag(secs) over w <= 2.0000005 then 0 else 1 end as opens from t2 window w as (partition by SecurityID, date order by secs, TradeIndex))",
    "bn as (select *, sum(opens) over (partition by SecurityID, date order by secs, TradeIndex rows unbounded preceding) as burst from bt)",
    f"b as (select SecurityID, date, burst, min(secs) as first, max(secs) as last, {_FLOW} from bn group by SecurityID, date, burst)",
)


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with their sides and a timestamp."""
    return tick_rule(adapters.trades(spark, sf_dir)).withColumn("ts", bursts.moment(F.col("date"), F.col("secs")))


def _secs(x: str):
    """Seconds of the day of a timestamp column."""
    return (F.unix_micros(x) - F.unix_micros(F.to_timestamp("date", "yyyyMMdd"))) / 1e6


@query("trade_bursts", _with(*_BURSTS) + f"\nSELECT SecurityID, date, {q('first', 'opens')}, {q('last', 'closes')}, trade_count, buy_count, {', '.join(q(c) for c in _FLOW_NAMES)} FROM b")
def trade_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows: trades that follow each other by two seconds at most."""
    out = bursts.bursts(_timed(spark, sf_dir), "2 seconds").withColumns({"opens": _secs("opens"), "closes": _secs("closes")})
    return _figures(out, ["opens", "closes", "trade_count", "buy_count", *_FLOW_NAMES], ["SecurityID", "date"], ("trade_count", "buy_count"))


@query("sliding_flow", _with(*_T) + f"\nSELECT SecurityID, date, cast(ceil(secs / 10) * 10 + k.ahead as bigint) AS window_end, {_FLOW.replace(' as volume', ' as v0').split(',')[0]}, {', '.join(q(f'{x}', c) for c, x in (('volume', 'sum(TradVolume)'), ('money', 'sum(TradeMoney)'), ('high', 'max(TradPrice)')))} FROM t2 CROSS JOIN (VALUES (0), (10), (20)) k(ahead) GROUP BY SecurityID, date, window_end")
def sliding_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of thirty seconds that end every ten."""
    out = bursts.sliding_flow(_timed(spark, sf_dir)).withColumn("window_end", _secs("window_end"))
    return _figures(out, ["window_end", "trade_count", "volume", "money", "high"], ["SecurityID", "date"], ("window_end", "trade_count"))


@query("order_response", _with(f"o as ({adapters.ORDER})", f"t as ({adapters.TRADE})") + f"""
SELECT o.SecurityID, o.date, o.OrderIndex, count(*) AS trade_count, {q('sum(t.TradVolume)', 'volume')} FROM o JOIN t ON t.SecurityID = o.SecurityID AND t.date = o.date AND t.secs >= o.secs AND t.secs <= o.secs + 2
WHERE o.OrderType = 'A' GROUP BY ALL""")
def order_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band join: what is traded within two seconds after each new order."""
    new = adapters.orders(spark, sf_dir).where("OrderType = 'A'").select("SecurityID", "date", "OrderIndex", "secs")
    ticks = adapters.trades(spark, sf_dir).select("SecurityID", "date", F.col("secs").alias("at"), "TradVolume")
    met = overlap.in_band(new, ticks, ["SecurityID", "date"], F.col("secs"), F.col("secs") + 2, F.col("at"), 2.0)
    out = met.groupBy("SecurityID", "date", "OrderIndex").agg(F.count("*").alias("trade_count"), F.sum("TradVolume").alias("volume"))
    return _figures(out, ["trade_count", "volume"], ["SecurityID", "date", "OrderIndex"], ("trade_count",))


@query("burst_quotes", _with(*_BURSTS, "u as (select SecurityID, date, secs as since, coalesce(lead(secs) over (partition by SecurityID, date order by timestamp), secs + 3) as until, AskPrice1 - BidPrice1 as spread from s)") + f"""
SELECT b.SecurityID, b.date, {q('b.first', 'opens')}, count(*) AS quotes, {q('max(u.spread)', 'spread')} FROM b JOIN u ON u.SecurityID = b.SecurityID AND u.date = b.date AND u.since < b.last + 0.5 AND b.first < u.until AND u.since < u.until
GROUP BY b.SecurityID, b.date, b.first""")
def burst_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overlap join: the quotes that were alive during each burst of trades and half a second after it."""
    from pyspark.sql import Window

    until = F.lead("secs").over(Window.partitionBy("SecurityID", "date").orderBy("timestamp"))
    quotes = adapters.snapshots(spark, sf_dir).select("SecurityID", "date", F.col("secs").alias("since"), F.coalesce(until, F.col("secs") + 3).alias("until"), (F.col("AskPrice1") - F.col("BidPrice1")).alias("spread"))
    b = bursts.bursts(_timed(spark, sf_dir), "2 seconds").select("SecurityID", "date", _secs("opens").alias("opens"), _secs("closes").alias("closes"))
    met = overlap.overlapping(b, quotes, ["SecurityID", "date"], (F.col("opens"), F.col("closes") + 0.5), (F.col("since"), F.col("until")), 2.0)
    out = met.groupBy("SecurityID", "date", "opens").agg(F.count("*").alias("quotes"), F.max("spread").alias("spread"))
    return _figures(out, ["opens", "quotes", "spread"], ["SecurityID", "date"], ("quotes",))


def _slices(df: DataFrame, folder: str, files: int = 4, many: int = 3) -> int:
    """Writes df (with ts) as files in the order of time less up to 40 seconds, one slice after another; files of a slice.

    df itself is run once; the edges and the slices are read from what that run has written.
    """
    late = F.unix_micros("ts") / 1e6 - F.pmod(F.xxhash64(*df.columns), F.lit(40_000)) / 1000.0
    rows = scratch.written(df.withColumn("late", late), "stream-rows")
    edges = [e for e in rows.select(F.percentile_approx("late", [k / many for k in range(1, many)], 1000).alias("e")).first()["e"] or []]
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        inside = (F.lit(True) if low is None else F.col("late") > low) & (F.lit(True) if high is None else F.col("late") <= high)
        rows.where(inside).drop("late").repartition(files).write.mode("append").parquet(folder)
    scratch.drop(rows)
    return files


@query("stream_as_of_book", _with(*_T, _T_SEEN) + f"\nSELECT SecurityID, date, TradeIndex, {q('BidPrice1', 'bid')}, {q('AskPrice1', 'ask')}, {q('mid')} FROM t3")
def stream_as_of_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """as_of_book from two streams: files of trades and snapshots that come in slices, rows up to 40 seconds out of order."""
    at = lambda df: df.withColumn("ts", bursts.moment(F.col("date"), F.col("secs")))
    book = at(adapters.snapshots(spark, sf_dir)).select("SecurityID", "date", "ts", "BidPrice1", "AskPrice1", "mid_price")
    ticks = at(adapters.trades(spark, sf_dir)).select("SecurityID", "date", "ts", "TradeIndex")
    streams = []
    for name, df in (("book", book), ("ticks", ticks)):
        folder = scratch.folder(spark, f"stream-{name}")
        many = _slices(df, folder, adapters.parts(spark, sf_dir, rows=1_000_000, least=4))
        asof.closing(spark, df.schema, "2030-01-01", {"SecurityID": "end", "date": "end"}).write.mode("append").parquet(folder)
        streams.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", many).parquet(folder))
    joined = asof.stream_as_of(streams[1], streams[0], ["BidPrice1", "AskPrice1", "mid_price"], ["TradeIndex"], parts=adapters.parts(spark, sf_dir, rows=asof.PART_ROWS))
    out, state = scratch.folder(spark, "stream-out"), scratch.folder(spark, "stream-state")
    before = spark.conf.get(asof.STATE_STORE[0])
    spark.conf.set(*asof.STATE_STORE)
    try:
        joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(asof.STATE_STORE[0], before)
    found = spark.read.schema(joined.schema).parquet(out)
    return found.select("SecurityID", "date", "TradeIndex", *[on_grid(f"at_{a}").alias(b) for a, b in (("BidPrice1", "bid"), ("AskPrice1", "ask"), ("mid_price", "mid"))])


@query("sketch_thresholds", """
WITH o AS (SELECT o_custkey % 50 AS k, strftime(o_orderdate, '%Y%m') AS m, o_totalprice AS x, o_orderkey FROM orders), d AS (
  SELECT DISTINCT m FROM o
), e AS (
  SELECT m, e AS earlier FROM (SELECT m, lag(m, j) OVER (ORDER BY m) AS e FROM d, (VALUES (1), (2), (3), (4), (5)) v(j) WHERE j = 1) UNION ALL SELECT m, lag(m, 2) OVER (ORDER BY m) FROM d UNION ALL SELECT m, lag(m, 3) OVER (ORDER BY m) FROM d
)
SELECT cast(k AS varchar) AS SecurityID, e.m AS date, count(x) AS n, true AS rank_within, true AS distinct_within FROM e JOIN o ON o.m = e.earlier GROUP BY ALL""")
def sketch_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 0.9 quantile of three months of order prices from monthly sketches: rows merged, and whether its rank among the
    exact values and the distinct count are within their bounds (three times the usual error)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 50).cast("string").alias("SecurityID"), F.date_format("o_orderdate", "yyyyMM").alias("date"), F.col("o_totalprice").alias("x"), "o_orderkey")
    months = [r["date"] for r in o.select("date").distinct().collect()]  # a row a month
    parts = adapters.parts(spark, sf_dir, "orders")
    found = sketches.thresholds(sketches.daily(o, F.col("x"), F.col("o_orderkey"), parts), months, 3)
    pairs = spark.createDataFrame(sketches.before(months, 3), "date string, earlier string")
    rows = o.repartition(parts, "o_orderkey").withColumnRenamed("date", "earlier").join(F.broadcast(pairs), "earlier").join(F.broadcast(found), ["SecurityID", "date"])  # 50 rows a month
    below, upto = F.count(F.when(F.col("x") < F.col("large_thresh"), 1)), F.count(F.when(F.col("x") <= F.col("large_thresh"), 1))
    # orders of one key are in one task, so a task counts its own and only counts meet
    keys = ["SecurityID", "date", "n", "distinct"]
    once = rows.groupBy(*keys, "o_orderkey").agg(below.alias("below"), upto.alias("upto"), F.count("x").alias("rows"))
    counted = once.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("below", "upto", "rows")], F.count("o_orderkey").alias("exact"))
    near, at = 3 * sketches.RANK_ERROR * F.col("rows") + 1, 0.9 * F.col("rows")
    within = (F.col("below") - near <= at) & (F.col("upto") + near >= at)
    return counted.select("SecurityID", "date", "n", within.alias("rank_within"), (F.abs(F.col("distinct") - F.col("exact")) <= 0.12 * F.col("exact") + 1).alias("distinct_within"))


_MARKET = "case when SecurityID like '6%' then 'sh' else 'sz' end"
_IC_CUBE = (
    *_FLOWS, "ol as (select *, case when mid_price > 0 then ln(mid_price) end as m from o)",
    "long as (" + " union all ".join(f"select {_MARKET} as market, date, timestamp, '{n}' as horizon, OFI as p, {_ret(k)} as q from ol" for n, k in _HORIZONS.items()) + ")",
    "ranked as (select market, date, timestamp, horizon, rank() over (w order by p) + (count(*) over (partition by market, date, timestamp, horizon, p) - 1) / 2.0 as rp, rank() over (w order by q) + (count(*) over (partition by market, date, timestamp, horizon, q) - 1) / 2.0 as rq from long where p is not null and q is not null window w as (partition by market, date, timestamp, horizon))",
    "ic as (select market, horizon, date, timestamp, case when timestamp <= 41400 then 'morning' else 'afternoon' end as session, (count(*) * sum(rp * rq) - sum(rp) * sum(rq)) / nullif(sqrt(count(*) * sum(rp * rp) - sum(rp) * sum(rp)) * sqrt(count(*) * sum(rq * rq) - sum(rq) * sum(rq)), 0) as x from ranked group by all having count(*) >= 4 and stddev_pop(rp) * stddev_pop(rq) > 0)",
)


@query("ic_cube", _with(*_IC_CUBE) + f"""
SELECT market, session, horizon, cast(grouping(market, session, horizon) as bigint) AS level, count(*) AS n, {q('avg(x)', 'mean')}, {q('stddev_pop(x)', 'std')}, {q('avg(x) / (stddev_pop(x) + 1e-8)', 'ratio')}, {q('avg(case when x > 0 then 1.0 else 0.0 end)', 'win_rate')}
FROM ic GROUP BY GROUPING SETS ((market, session, horizon), (market, horizon), (session, horizon), (horizon), ())""")
def ic_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations by market, session and horizon, and what sums over them, from one aggregate."""
    out = cube.ic_cube(_predicted(spark, sf_dir), "OFI", list(_HORIZONS), 4, parts=_sections(spark, sf_dir, len(_HORIZONS)))
    return _figures(out, ["level", "n", "mean", "std", "ratio", "win_rate"], ["market", "session", "horizon"], ("level", "n"))


def _curve(side: str, price: str, volume: str, sign: str) -> str:
    there = lambda i: f"{price}{i} > 0"
    upto = lambda i, x: " + ".join(f"(case when {there(j)} then coalesce({x(j)}, 0) else 0 end)" for j in range(1, i + 1))
    depth, money = lambda i: upto(i, lambda j: f"{volume}{j}"), lambda i: upto(i, lambda j: f"{price}{j} * {volume}{j}")
    return " union all ".join(f"select SecurityID, date, timestamp, '{side}' as side, {i} as level, {price}{i} as price, {sign} * ({price}{i} - {_MID_OF}) as distance, {depth(i)} as depth, {money(i)} as amount, case when {depth(10)} > 0 then ({depth(i)}) / ({depth(10)}) else 0.0 end as share from s where {there(i)}" for i in range(1, 11))


_MID_OF = "mid_price"


@query("depth_curves", _with(S, f"c as ({_curve('bid', 'BidPrice', 'BidVolume', '-1')} union all {_curve('ask', 'AskPrice', 'AskVolume', '1')})") + f"\nSELECT SecurityID, date, timestamp, side, cast(level as bigint) AS level, {', '.join(q(c) for c in ('price', 'distance', 'depth', 'amount', 'share'))} FROM c")
def depth_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function over Arrow batches: both sides of each book as curves of depth."""
    return _figures(curves.depth_curves(adapters.snapshots(spark, sf_dir)), ["level", "price", "distance", "depth", "amount", "share"], [*KEYS, "side"], ("level",))


