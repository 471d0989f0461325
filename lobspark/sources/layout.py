"""Market files as the two exchanges write them, made from the driver's tables: other names, codes and types for each market.

They hold what the readers have to deal with: two snapshots in one bucket, rows outside trading hours, cancelled trades,
order kinds that aren't used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXECUTED, ORDER_KINDS, SIDES, SZ_SNAP_NAMES
from . import adapters
from .scratch import drop, written
from .scratch import folder as scratch


def clock(secs: Column) -> Column:
    """Seconds as HH:MM:SS.mmm."""
    ms = F.round(secs * 1000).cast("long")
    part = lambda unit, most, digits: F.lpad((F.floor(ms / unit) % most).cast("string"), digits, "0")
    return F.concat(part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3))


IS_SH, IS_SZ = "SecurityID LIKE '6%'", "SecurityID NOT LIKE '6%'"
LEVELS = range(1, 11)


def snapshots(df: DataFrame, market: str) -> DataFrame:
    """One market's snapshot files; every tenth or so bucket has an earlier snapshot too, with another last price."""
    df = df.where(IS_SH if market == "sh" else IS_SZ)
    twice = F.expr("secs > timestamp AND MOD(CAST(BidVolume1 AS INT), 1000) = 0")
    df = df.withColumn("early", F.explode(F.when(twice, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    df = df.withColumns({"secs": F.when(F.col("early"), F.col("timestamp").cast("double")).otherwise(F.col("secs")), "LastPrice": F.when(F.col("early"), F.lit(1.0)).otherwise(F.col("LastPrice"))})
    volume = "float" if market == "sh" else "int"
    columns = [clock(F.col("secs")).alias("UpdateTime"), F.col("SecurityID"), *(F.col(c).cast("float").alias(c) for c in ("PreCloPrice", "LastPrice"))]
    columns += [F.col(f"{s}Price{i}").cast("float").alias(f"{s}Price{i}") for s in ("Bid", "Ask") for i in LEVELS]
    columns += [F.col(f"{s}Volume{i}").cast(volume).alias(f"{s}Volume{i}") for s in ("Bid", "Ask") for i in LEVELS]
    columns += [F.col(f"NumOrders{s}{i}").cast("int").alias(f"NumOrders{s}{i}") for s in "BS" for i in LEVELS]
    if market == "sh":
        columns += [F.col(c).cast("int").alias(c) for c in ("MaxBidDur", "MaxSellDur")] + [F.col("BidVolume1").cast("float").alias("TotalBidVol")]
    else:
        columns += [F.col(c).cast("float").alias(c) for c in ("HighLimitPrice", "LowLimitPrice")] + [F.col("BidVolume1").cast("int").alias(next(a for a, b in SZ_SNAP_NAMES.items() if b == "TotalBidVol"))]
    return df.select(*columns, "date")


def trades(df: DataFrame, market: str) -> DataFrame:
    """One market's trade files; the second market's have cancellations between the trades, and no sides."""
    if market == "sh":
        return df.where(IS_SH).select("SecurityID", clock(F.col("secs")).alias("TradTime"), *(F.col(c).cast("float").alias(c) for c in ("TradPrice", "TradVolume", "TradeMoney")), "TradeBSFlag", F.col("TradeIndex").cast("int").alias("TradeIndex"), "date")
    rows = df.where(IS_SZ).select("SecurityID", clock(F.col("secs")).alias("TransactTime"), F.col("TradPrice").cast("float").alias("LastPx"), F.col("TradVolume").cast("int").alias("LastQty"), F.col("TradeIndex").cast("int").alias("ApplSeqNum"), F.lit(EXECUTED).alias("ExecType"), "date")
    return rows.unionByName(rows.where("MOD(ApplSeqNum, 7) = 0").withColumn("ExecType", F.lit(52)))


def orders(df: DataFrame, market: str) -> DataFrame:
    """One market's order files; the second market's hold kinds that aren't used."""
    if market == "sh":
        return df.where(IS_SH).select("SecurityID", clock(F.col("secs")).alias("OrderTime"), F.col("OrderPrice").cast("float").alias("OrderPrice"), F.col("Balance").cast("float").alias("Balance"), "OrderBSFlag", "OrderType", F.col("OrderIndex").cast("int").alias("OrderIndex"), "date")
    code = lambda name, codes: F.coalesce(*[F.when(F.col(name) == v, F.lit(k)) for k, v in codes.items()])
    rows = df.where(IS_SZ).select("SecurityID", clock(F.col("secs")).alias("TransactTime"), F.col("OrderPrice").cast("float").alias("Price"), F.col("Balance").cast("int").alias("OrderQty"), code("OrderBSFlag", SIDES).alias("Side"), code("OrderType", ORDER_KINDS).alias("OrdType"), F.col("OrderIndex").cast("int").alias("ApplSeqNum"), "date")
    return rows.unionByName(rows.where("MOD(ApplSeqNum, 5) = 0").withColumn("OrdType", F.lit(85)))


def write(spark: SparkSession, sf_dir: str, *kinds: str) -> str:
    """Writes type={snap|trade|order}_{sh|sz}/date=... and returns their root."""
    root = scratch(spark, "market")
    for kind in kinds:
        make, source = {"snap": (snapshots, adapters.snapshots), "trade": (trades, adapters.trades), "order": (orders, adapters.orders)}[kind]
        for market in ("sh", "sz"):
            make(source(spark, sf_dir), market).write.partitionBy("date").parquet(f"{root}/type={kind}_{market}")
    return root


def write_drifting(spark: SparkSession, sf_dir: str) -> str:
    """Snapshots whose files change on the second day: a column goes, one comes, volumes and prices have other types.

    A market's day is a write of its own, so lines are dealt out and sorted once, for all four."""
    root, lines = scratch(spark, "drifting"), written(adapters.timed(spark, sf_dir), "timed")
    for market in ("sh", "sz"):
        rows = snapshots(adapters.snapshots_of(lines), market)
        gone = "MaxBidDur" if market == "sh" else "HighLimitPrice"
        later = rows.withColumns({"BidVolume1": F.col("BidVolume1").cast("long"), "LastPrice": F.col("LastPrice").cast("double"), "Extra": F.col("BidVolume2").cast("smallint")}).drop(gone)
        for date, df in (("20240102", rows), ("20240103", later)):
            df.where(F.col("date") == date).drop("date").write.parquet(f"{root}/type=snap_{market}/date={date}")
    drop(lines)
    return root
