"""Readers of snapshots, trades and orders of two exchanges, unified to one schema.

Layout: type={snap|trade|order}_{sh|sz}/date={YYYYMMDD}/*.parquet. All dates are one lazy scan: a filter on date prunes
partitions, columns that nobody uses aren't read. Dates come from a listing of the folders, no file is opened for them.

Columns and their types may change from day to day. One footer a date is read when a market is first asked for; dates with
one schema are one scan, and the scans are united: a column that a date lacks is null, one of several number types is the
type that holds them all.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, LongType, NumericType, StringType, StructField, StructType

from ..config import EXECUTED, ORDER_KINDS, SECONDARY_TEXT, SIDES, SNAP_REQUIRED, SZ_SNAP_NAMES, TRADING_HOURS
from ..functions import timegrid

MARKETS = ("sh", "sz")


class MarketData:
    """A data root. Reads are lazy; a market without files is left out, and it is an error if both are missing."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._scans: dict[tuple[str, str], DataFrame | None] = {}

    def _folders(self, kind: str, market: str) -> dict[str, str]:
        """The folder of each date, from one listing."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.root}/type={kind}_{market}/date=*")
        found = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(top) or []
        paths = [f.getPath() for f in found if f.isDirectory()]
        return {p.getName().split("=", 1)[1]: p.toString() for p in sorted(paths, key=lambda p: p.getName())}

    def _schema(self, folder: str) -> StructType | None:
        try:
            return self.spark.read.parquet(folder).schema
        except AnalysisException as e:
            if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
                return None
            raise

    def _scan(self, kind: str, market: str) -> DataFrame | None:
        if (kind, market) not in self._scans:
            folders = self._folders(kind, market)
            with ThreadPoolExecutor(8) as pool:
                schemas = dict(zip(folders, pool.map(self._schema, folders.values()), strict=True))
            groups: dict[str, list[str]] = {}
            for date, schema in schemas.items():
                if schema is not None:
                    groups.setdefault(schema.json(), []).append(date)
            base = f"{self.root}/type={kind}_{market}"
            parts = []
            for dates in groups.values():
                schema = StructType([*(f for f in schemas[dates[0]].fields if f.name != "date"), StructField("date", StringType())])
                paths = [base] if len(groups) == 1 else [folders[d] for d in dates]
                parts.append(self.spark.read.schema(schema).option("basePath", base).parquet(*paths))
            self._scans[kind, market] = united(parts) if parts else None
        return self._scans[kind, market]

    def _both(self, kind: str, unify) -> DataFrame:
        parts = [unify(df, m) for m in MARKETS if (df := self._scan(kind, m)) is not None]
        if not parts:
            raise RuntimeError(f"no {kind} data in {self.root}")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)

    def market_snapshots(self, market: str, columns: list[str] | None = None) -> DataFrame:
        """One market's snapshots in trading hours, under unified names; columns it lacks are null doubles."""
        df = self._scan("snap", market)
        if df is None:
            raise FileNotFoundError(f"{self.root}/type=snap_{market}")
        return snapshots(df, market, columns)

    def snapshots(self, columns: list[str] | None = None) -> DataFrame:
        """Both markets on the grid, one row for each stock, date and bucket."""
        return on_grid(self._both("snap", lambda df, m: snapshots(df, m, columns)))

    def trades(self) -> DataFrame:
        return self._both("trade", trades)

    def orders(self) -> DataFrame:
        return self._both("order", orders)

    def dates(self, start: str | None = None, end: str | None = None) -> list[str]:
        """Trading dates of the SH snapshots, from the names of their folders."""
        return [d for d in self._folders("snap", "sh") if (not start or d >= start) and (not end or d <= end)]


def wider(a: DataType, b: DataType) -> DataType:
    """The type that a column has if one day has a and another b."""
    if a == b:
        return a
    if not (isinstance(a, NumericType) and isinstance(b, NumericType)):
        return StringType()
    return DoubleType() if any(isinstance(t, (FloatType, DoubleType, DecimalType)) for t in (a, b)) else LongType()


def united(parts: list[DataFrame]) -> DataFrame:
    """All rows of frames that share some columns, each column in the type that holds all of them; what a frame lacks is null."""
    types: dict[str, DataType] = {}
    for df in parts:
        for f in df.schema.fields:
            types[f.name] = wider(types.get(f.name, f.dataType), f.dataType)
    own = [{f.name: f.dataType for f in df.schema.fields} for df in parts]
    cast = [df.select([(F.col(n) if have.get(n) == t else F.col(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in types.items()]) for df, have in zip(parts, own, strict=True)]
    return reduce(DataFrame.union, cast)


def snapshots(df: DataFrame, market: str, columns: list[str] | None = None) -> DataFrame:
    wanted = list(dict.fromkeys([*SNAP_REQUIRED, *(columns or [])]))
    if market == "sz":
        df = df.withColumnsRenamed({a: b for a, b in SZ_SNAP_NAMES.items() if a in df.columns})
    df = df.where(F.col("UpdateTime").between(*TRADING_HOURS))
    if columns is None:
        wanted = list(dict.fromkeys([*wanted, *[c for c in df.columns if c not in ("date", "type")]]))
    pick = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c)
    return df.select("date", *[pick(c) for c in wanted if c != "date"])


def on_grid(df: DataFrame) -> DataFrame:
    """Numbers as doubles, the bucket, the true time, and of each bucket the latest snapshot."""
    numbers = {f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in SECONDARY_TEXT}
    df = df.withColumns(numbers).withColumns({"timestamp": timegrid.floor_bucket(F.col("UpdateTime")), "secs": timegrid.seconds(F.col("UpdateTime"))})
    latest = F.row_number().over(Window.partitionBy("SecurityID", "date", "timestamp").orderBy(F.desc("UpdateTime")))
    return df.withColumn("__n", latest).where("__n = 1").drop("__n")


TRADE_COLUMNS = ["date", "SecurityID", "TradTime", "TradPrice", "TradVolume", "TradeMoney", "TradeBSFlag", "TradeIndex"]
ORDER_COLUMNS = ["date", "SecurityID", "OrderTime", "OrderPrice", "Balance", "OrderBSFlag", "OrderType", "OrderIndex"]


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def trades(df: DataFrame, market: str) -> DataFrame:
    """Executed trades; SZ sides are unknown here and come from the tick rule."""
    if market == "sz":
        df = df.where(F.col("ExecType") == EXECUTED).withColumnsRenamed({"TransactTime": "TradTime", "LastPx": "TradPrice", "LastQty": "TradVolume", "ApplSeqNum": "TradeIndex"})
        df = df.withColumns({"TradeMoney": F.col("TradPrice").cast("double") * F.col("TradVolume").cast("double"), "TradeBSFlag": F.lit(None).cast("string")})
    return _doubles(df, "TradPrice", "TradVolume", "TradeMoney").withColumn("TradeIndex", F.col("TradeIndex").cast("long")).select(*TRADE_COLUMNS)


def _decoded(column: str, codes: dict[int, str]):
    out = F.lit(None).cast("string")
    for code, name in codes.items():
        out = F.when(F.col(column) == code, F.lit(name)).otherwise(out)
    return out


def orders(df: DataFrame, market: str) -> DataFrame:
    """New orders (A) and cancellations (D); other SZ kinds are dropped."""
    if market == "sz":
        df = df.withColumns({"OrderBSFlag": _decoded("Side", SIDES), "OrderType": _decoded("OrdType", ORDER_KINDS)}).where(F.col("OrderBSFlag").isNotNull() & F.col("OrderType").isNotNull())
        df = df.withColumnsRenamed({"TransactTime": "OrderTime", "Price": "OrderPrice", "OrderQty": "Balance", "ApplSeqNum": "OrderIndex"})
    return _doubles(df, "OrderPrice", "Balance").withColumn("OrderIndex", F.col("OrderIndex").cast("long")).select(*ORDER_COLUMNS)
