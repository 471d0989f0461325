"""Trades as a stream: three-second buckets with a watermark, and the moving average of a bucketed figure with kept state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EMA_SPAN
from ..functions.nulls import count0, div, sum0


def trade_buckets(trades: DataFrame, time: str = "ts", late: str = "10 seconds") -> DataFrame:
    """Streaming trades (time as a timestamp, SecurityID, TradPrice, TradVolume, TradeMoney, TradeBSFlag) by stock and bucket.

    Buckets are (T - 3 s, T]: a time on the grid belongs to the bucket that ends there. Trades later than the watermark
    are left out; a bucket is emitted once it can't change any more.
    """
    buy, sell = F.col("TradeBSFlag") == "B", F.col("TradeBSFlag") == "S"
    # windows are [T - 3 s, T): seen a microsecond earlier, a time on the grid falls into the one that ends there
    rows = trades.withColumn(time, F.col(time) - F.expr("INTERVAL 1 MICROSECOND")).withWatermark(time, late)
    out = rows.groupBy("SecurityID", F.window(time, "3 seconds").alias("w")).agg(
        sum0(F.col("TradeMoney"), buy).alias("trade_buy_amt"),
        sum0(F.col("TradeMoney"), sell).alias("trade_sell_amt"),
        count0(buy).alias("trade_buy_cnt"),
        count0(sell).alias("trade_sell_cnt"),
        F.count("*").alias("trade_count"),
        sum0(F.col("TradVolume")).alias("trade_vwap_den"),
        sum0(F.col("TradPrice") * F.col("TradVolume")).alias("__num"),
    )
    return out.select("SecurityID", F.col("w.end").alias("bucket_end"), *[c for c in out.columns if c not in ("SecurityID", "w", "__num")], div(F.col("__num"), F.col("trade_vwap_den")).alias("trade_vwap"))


def stream_ema(values: DataFrame, value: str, order: str = "bucket_end", span: int = EMA_SPAN) -> DataFrame:
    """(SecurityID, order, value, ema) of a stream; each stock's last average is its state between batches.

    Rows of a batch are taken in their order; a stock's rows must not come in an earlier batch than older ones.
    """
    a = 2.0 / (span + 1)
    kind = values.schema[order].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order)
        last = state.get[0] if state.exists else None
        out = []
        for x in rows[value]:
            last = x if last is None else last + a * (x - last)
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({"SecurityID": rows["SecurityID"], order: rows[order], value: rows[value], "ema": out})

    return values.groupBy("SecurityID").applyInPandasWithState(step, f"SecurityID string, {order} {kind}, {value} double, ema double", "ema double", "append", "NoTimeout")
