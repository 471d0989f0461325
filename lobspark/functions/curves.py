"""A table function over Arrow batches: the ten levels of a book as curves of depth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 10
SIDES = (("bid", "BidPrice", "BidVolume", -1.0), ("ask", "AskPrice", "AskVolume", 1.0))
CURVE = "SecurityID string, date string, timestamp int, side string, level int, price double, distance double, depth double, amount double, share double"


def _matrix(rows: pa.RecordBatch, name: str) -> np.ndarray:
    """The levels of a column of arrays, or of ten columns, as rows of ten; nulls are NaN."""
    if name in rows.schema.names:
        return rows.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, LEVELS)
    if not rows.num_rows:
        return np.zeros((0, LEVELS))
    return np.column_stack([rows.column(f"{name}{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(1, LEVELS + 1)])


@F.arrow_udtf(returnType=CURVE)
class DepthCurve:
    """Rows of a book to a row for each side and level with a price above 0: how far it is from the middle price, how much volume
    and money rest up to it, and which share of the side's volume. Null volumes count as 0. A call sees whole Arrow batches."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        matrix = lambda name: _matrix(rows, name)
        mid = rows.column("mid_price").to_numpy(zero_copy_only=False).astype(float)
        for side, price_name, volume_name, sign in SIDES:
            price, volume = matrix(price_name), np.nan_to_num(matrix(volume_name))
            there = price > 0  # not for missing prices
            volume = np.where(there, volume, 0.0)
            depth, amount = volume.cumsum(axis=1), np.where(there, price * volume, 0.0).cumsum(axis=1)
            who, level = np.nonzero(there)
            whole = depth[who, -1]
            share = np.divide(depth[who, level], whole, out=np.zeros(len(who)), where=whole > 0)
            distance = sign * (price[who, level] - mid[who])
            keys = [rows.column(c).take(pa.array(who)) for c in ("SecurityID", "date", "timestamp")]
            values = [pa.array([side] * len(who), pa.string()), pa.array(level + 1, pa.int32()), *(pa.array(x, pa.float64()) for x in (price[who, level], distance, depth[who, level], amount[who, level], share))]
            yield pa.table([*keys, *values], names=["SecurityID", "date", "timestamp", "side", "level", "price", "distance", "depth", "amount", "share"])


def depth_curves(book: DataFrame) -> DataFrame:
    """The curves of all rows of a book (SecurityID, date, timestamp, mid_price and ten levels); rows aren't shuffled.

    Levels go to the function as four arrays: Spark asks for the size of every column of a batch at every row."""
    levels = [F.array(*[F.col(f"{n}{i}").cast("double") for i in range(1, LEVELS + 1)]).alias(n) for _, p, v, _ in SIDES for n in (p, v)]
    return DepthCurve(book.select("SecurityID", "date", F.col("timestamp").cast("int").alias("timestamp"), F.col("mid_price").cast("double").alias("mid_price"), *levels).asTable())


def register(spark) -> None:
    """Makes the function known to SQL: SELECT * FROM depth_curve(TABLE(book))."""
    spark.udtf.register("depth_curve", DepthCurve)
