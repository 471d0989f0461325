"""Aggregates of trades by stock and bucket, and the features of them.

Both markets are one normalised table before anything is aggregated: a stock belongs to one market, so nothing has to be
merged again afterwards. Book, sides and streaks come from one sorted stream, then there is one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import timegrid
from ..functions.nulls import count0, div, imbalance, nearest_quantile, rat, sum0
from ..functions.windows import STOCK, section_window, stream, stream_window
from .registry import feature

KEYS = [*STOCK, "timestamp"]
AMOUNTS = ["trade_buy_amt", "trade_sell_amt", "trade_large_buy", "trade_large_sell", "pen_buy_amt", "pen_sell_amt"]
COUNTS = ["trade_buy_cnt", "trade_sell_cnt", "trade_count", "pen_buy_cnt", "pen_sell_cnt", "max_consec_buy", "max_consec_sell"]
OTHERS = ["trade_vwap", "trade_vwap_den", "trade_price_dispersion", "trade_price_dev"]


def sides(price: Column, known: Column, window: WindowSpec) -> dict[str, Column]:
    """Columns, one after another, that end in __flag: the known side, or that of the tick rule.

    B above the previous price, S below, else as before; B for a leading run. price is null in rows that aren't trades.
    """
    before = F.last(price, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    moved = F.when(price > F.col("__before"), "B").when(price < F.col("__before"), "S")
    carried = F.last("__moved", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return {"__before": before, "__moved": moved, "__flag": F.coalesce(known, carried, F.lit("B"))}


def tick_rule(trades: DataFrame) -> DataFrame:
    """Fills the missing sides of trades."""
    out = trades
    for name, column in sides(F.col("TradPrice"), F.col("TradeBSFlag"), Window.partitionBy(*STOCK).orderBy("secs", "TradeIndex")).items():
        out = out.withColumn(name, column)
    return out.withColumn("TradeBSFlag", F.col("__flag")).drop("__before", "__moved", "__flag")


def previous_day(dates: DataFrame | list[str], spark: SparkSession) -> DataFrame:
    """(date, previous): trading dates with the one before; a row a day, in one small task. A list saves reading a table for it."""
    if isinstance(dates, list):
        days = sorted(set(dates))
        return spark.createDataFrame(list(zip(days, [None, *days[:-1]], strict=True)), "date string, previous string")
    days = dates.select("date").distinct()
    return days.select("date", F.lag("date").over(Window.orderBy("date")).alias("previous"))


def thresholds(events: DataFrame, amount: Column, days: DataFrame | list[str]) -> DataFrame:
    """(SecurityID, date, large_thresh): the 0.9 quantile of a stock's amounts on the previous trading day."""
    own = events.groupBy(*STOCK).agg(nearest_quantile(amount, 0.9).alias("large_thresh"))
    return own.withColumnRenamed("date", "previous").join(F.broadcast(previous_day(days, events.sparkSession)), "previous").select(*STOCK, "large_thresh")  # a row a day


def in_order(trades: DataFrame, grid: DataFrame) -> DataFrame:
    """Trades with their side (TradeBSFlag), the book before them (at_...), their place in a streak of one side within
    their bucket (__streak), and their bucket's mean price (__mean), all from one stream of trades and book rows that is sorted once.

    Book rows leave as soon as each trade has its own: what follows is windows over trades in the order they already have.
    """
    book = ["BidPrice1", "AskPrice1", "mid_price"]
    both = stream(trades, grid, "secs", "secs", book, turn="TradeIndex").where("__side = 1")
    upto = stream_window()
    so_far = upto.rowsBetween(Window.unboundedPreceding, -1)
    steps = {"__count": F.count(F.lit(1)).over(upto)} | sides(F.col("__event.TradPrice"), F.col("__event.TradeBSFlag"), upto)
    steps["__key"] = F.struct(F.col("__bucket").alias("t"), F.col("__flag").alias("flag"))
    steps["__opens"] = F.when(~F.col("__key").eqNullSafe(F.last("__key", ignorenulls=True).over(so_far)), F.col("__count"))
    steps["__streak"] = F.col("__count") - F.last("__opens", ignorenulls=True).over(upto) + 1
    steps["__mean"] = F.avg("__event.TradPrice").over(Window.partitionBy(*STOCK, "__bucket"))
    for name, column in steps.items():
        both = both.withColumn(name, column)
    events = [F.col(f"__event.{x}").alias(x) for x in trades.columns if x not in (*STOCK, "TradeBSFlag")]
    return both.select(*STOCK, F.col("__bucket").alias("timestamp"), *events, F.col("__flag").alias("TradeBSFlag"), "__streak", "__mean", *[F.col(f"__last.{x}").alias(f"at_{x}") for x in book])


def aggregate(trades: DataFrame, grid: DataFrame, days: list[str] | None = None) -> DataFrame:
    """Trades (SecurityID, date, TradTime or secs, TradPrice, TradVolume, TradeMoney, TradeBSFlag, TradeIndex) by bucket.

    grid: snapshots with secs (true time), BidPrice1, AskPrice1, mid_price; the last one at or before a trade is its book.
    days: all trading days, if they are known; else they are read from both tables.
    """
    if "secs" not in trades.columns:
        trades = trades.withColumn("secs", timegrid.seconds(F.col("TradTime")))
    trades = trades.select(*STOCK, "secs", "TradPrice", "TradVolume", "TradeMoney", "TradeBSFlag", "TradeIndex")
    limits = thresholds(trades, F.col("TradeMoney"), days if days is not None else trades.select("date").union(grid.select("date")))
    seen = in_order(trades, grid).join(limits, list(STOCK), "left")
    buy, sell = F.col("TradeBSFlag") == "B", F.col("TradeBSFlag") == "S"
    large = F.col("TradeMoney") >= F.col("large_thresh")
    pen_buy, pen_sell = buy & (F.col("TradPrice") > F.col("at_AskPrice1")), sell & (F.col("TradPrice") < F.col("at_BidPrice1"))
    price, volume, money = F.col("TradPrice"), F.col("TradVolume"), F.col("TradeMoney")
    deviation = F.coalesce(F.try_divide(F.abs(price - F.col("at_mid_price")), F.col("at_mid_price")), F.lit(0.0))
    longest = lambda side: F.coalesce(F.max(F.when(side, F.col("__streak"))), F.lit(0).cast("long"))
    out = seen.groupBy(*KEYS).agg(
        sum0(money, buy).alias("trade_buy_amt"),
        sum0(money, sell).alias("trade_sell_amt"),
        sum0(money, buy & large).alias("trade_large_buy"),
        sum0(money, sell & large).alias("trade_large_sell"),
        count0(buy).alias("trade_buy_cnt"),
        count0(sell).alias("trade_sell_cnt"),
        F.count("*").alias("trade_count"),
        sum0(volume).alias("trade_vwap_den"),
        sum0(price * volume).alias("__num"),
        F.avg(F.try_divide(F.abs(price - F.col("__mean")), F.col("__mean"))).alias("trade_price_dispersion"),
        count0(pen_buy).alias("pen_buy_cnt"),
        count0(pen_sell).alias("pen_sell_cnt"),
        sum0(money, pen_buy).alias("pen_buy_amt"),
        sum0(money, pen_sell).alias("pen_sell_amt"),
        F.avg(deviation).alias("trade_price_dev"),
        longest(buy).alias("max_consec_buy"),
        longest(sell).alias("max_consec_sell"),
    )
    return out.withColumn("trade_vwap", div(F.col("__num"), F.col("trade_vwap_den"))).drop("__num")


def join_grid(grid: DataFrame, stats: DataFrame) -> DataFrame:
    """The grid with the aggregates of its buckets; buckets without trades have none."""
    return grid.join(stats, KEYS, "left")


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


TRADE = {"source": "trades"}


def _pair(name: str, a: str, b: str) -> None:
    feature(name, [a, b], **TRADE)(lambda: imbalance(_zero(a), _zero(b)))


_pair("TradeImb", "trade_buy_amt", "trade_sell_amt")
_pair("LargeTradeRatio", "trade_large_buy", "trade_large_sell")
_pair("ConsecutiveBS", "max_consec_buy", "max_consec_sell")
_pair("BuySellCountImb", "trade_buy_cnt", "trade_sell_cnt")


@feature("TradeVWAPDev", ["trade_vwap", "mid_price"], **TRADE)
def trade_vwap_dev() -> Column:
    return div(F.col("trade_vwap"), F.col("mid_price")) - 1


@feature("TradeIntensity", ["trade_count"], **TRADE)
def trade_intensity() -> Column:
    return F.coalesce(F.col("trade_count"), F.lit(0)).cast("long")


def _section_median(name: str, x: str) -> None:
    """The median of a column over its section, from its rows in order: the middle one, or the mean of the middle two.

    Both windows share the section's exchange; a percentile aggregate over a window costs many times as much.
    """
    turn = f"{name}_turn"
    feature(turn, needs=[x], helper=True, section=True, **TRADE)(lambda: F.row_number().over(section_window().orderBy(x)))
    size = lambda: F.count("*").over(section_window())
    feature(f"{name}_size", needs=[x], helper=True, section=True, **TRADE)(size)
    middle = lambda: (F.col(turn) * 2).between(F.col(f"{name}_size"), F.col(f"{name}_size") + 2)
    feature(name, needs=[turn, f"{name}_size"], helper=True, section=True, **TRADE)(lambda: F.avg(F.when(middle(), F.col(x))).over(section_window()))


_section_median("__median", "TradeIntensity")
feature("__apart", needs=["TradeIntensity", "__median"], helper=True, **TRADE)(lambda: F.abs(F.col("TradeIntensity") - F.col("__median")))
_section_median("__mad", "__apart")


@feature("TradeIntensityZ", needs=["TradeIntensity", "__median", "__mad"], **TRADE)
def trade_intensity_z() -> Column:
    return rat(F.col("TradeIntensity") - F.col("__median"), 1.4826 * F.col("__mad"))


for _name, _column in (("TradePriceDev", "trade_price_dev"), ("TradePriceDispersion", "trade_price_dispersion")):
    feature(_name, [_column], **TRADE)(lambda c=_column: F.col(c))


@feature("TradePenetration", ["pen_buy_amt", "pen_sell_amt", "trade_buy_amt", "trade_sell_amt"], **TRADE)
def trade_penetration() -> Column:
    return rat(_zero("pen_buy_amt") - _zero("pen_sell_amt"), _zero("trade_buy_amt") + _zero("trade_sell_amt"))


@feature("AvgTradeSize", ["trade_buy_amt", "trade_sell_amt", "trade_count"], **TRADE)
def avg_trade_size() -> Column:
    return rat(_zero("trade_buy_amt") + _zero("trade_sell_amt"), _zero("trade_count"))
