"""Bursts of trades (session windows) and flow in sliding windows, of tables and of streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import count0, div, sum0
from ..functions.windows import STOCK


def moment(date: Column, secs: Column) -> Column:
    """The timestamp of seconds (with fraction) of a day yyyyMMdd, to the microsecond."""
    day = F.unix_micros(F.to_timestamp(date, "yyyyMMdd"))
    return F.timestamp_micros(day + F.round(secs * 1_000_000).cast("long"))


def _flow() -> list[Column]:
    buy, sell, money = F.col("TradeBSFlag") == "B", F.col("TradeBSFlag") == "S", F.col("TradeMoney")
    return [F.count("*").alias("trade_count"), sum0(F.col("TradVolume")).alias("volume"), sum0(money).alias("money"), sum0(money, buy).alias("buy_money"), sum0(money, sell).alias("sell_money"), count0(buy).alias("buy_count"), F.min("TradPrice").alias("low"), F.max("TradPrice").alias("high")]


def _late(trades: DataFrame, time: str, late: str | None) -> DataFrame:
    return trades.withWatermark(time, late) if late and trades.isStreaming else trades


def bursts(trades: DataFrame, gap: str = "2 seconds", time: str = "ts", late: str | None = "10 seconds") -> DataFrame:
    """Trades of a stock's day that follow each other by gap at most, as one row: its first and last moment, and flow.

    time is a timestamp; rows without one are left out. Of a stream, a burst is emitted once the watermark has passed its
    end by the gap, and trades that come later than the watermark are left out. Partial bursts are merged before the shuffle.
    """
    rows = _late(trades, time, late)
    out = rows.groupBy(*STOCK, F.session_window(time, gap).alias("w")).agg(F.min(time).alias("opens"), F.max(time).alias("closes"), *_flow())
    return out.drop("w").withColumn("imbalance", div(F.col("buy_money") - F.col("sell_money"), F.col("buy_money") + F.col("sell_money")))


def sliding_flow(trades: DataFrame, length: str = "30 seconds", step: str = "10 seconds", time: str = "ts", late: str | None = "10 seconds") -> DataFrame:
    """Flow of a stock's day in windows (end - length, end] that end every step; a trade is in length / step of them."""
    rows = _late(trades.withColumn(time, F.col(time) - F.expr("INTERVAL 1 MICROSECOND")), time, late)
    out = rows.groupBy(*STOCK, F.window(time, length, step).alias("w")).agg(*_flow())
    return out.select(*STOCK, F.col("w.end").alias("window_end"), *[c for c in out.columns if c not in (*STOCK, "w")])
