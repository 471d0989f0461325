"""Realised moments of the middle price over the last 300 snapshots of a stock's day."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..config import EPS, MOMENT_MIN_ROWS, MOMENT_ROWS
from ..functions.windows import lag, largest, rolling, stock_window
from .registry import feature

MID = ["mid_price"]


@feature("__return", MID, helper=True)
def step_return() -> Column:
    """Log return on the previous snapshot; 0 in the first bucket, null where a price is missing."""
    ln = F.when(F.col("mid_price") > 0, F.ln("mid_price"))
    return F.when(F.row_number().over(stock_window()) == 1, F.lit(0.0)).otherwise(ln - lag(ln))


feature("__scale", MID, needs=["__return"], helper=True)(lambda: largest(F.col("__return")))


@feature("__count", MID, needs=["__return"], helper=True)
def returns_in_frame() -> Column:
    upto = lambda end: F.count("__return").over(stock_window().rowsBetween(Window.unboundedPreceding, end))
    return (upto(0) - upto(-MOMENT_ROWS)).cast("double")


def _rolled(name: str, power: int, x, helper: bool = True) -> None:
    """Sum over the last rows of a power of returns, where enough of them have one. Returns are summed as shares of the day's largest."""
    window = f"__w_{name}"
    feature(window, MID, needs=["__return", "__scale"], helper=True)(lambda: rolling(x(F.col("__return") / F.col("__scale")), MOMENT_ROWS))
    feature(name, needs=sorted({window, "__count", "__scale"}), helper=helper)(lambda: F.when(F.col("__count") >= MOMENT_MIN_ROWS, F.col(window) * F.pow("__scale", F.lit(power))))


feature("__n", needs=["__count"], helper=True)(lambda: F.when(F.col("__count") >= MOMENT_MIN_ROWS, F.col("__count")))
_rolled("__r3", 3, lambda r: r * r * r)
_rolled("__r4", 4, lambda r: (r * r) * (r * r))
_rolled("__up", 2, lambda r: F.when(r > 0, r * r))
_rolled("__down", 2, lambda r: F.when(r < 0, r * r))
_rolled("RVol", 2, lambda r: r * r, helper=False)


def _gated(x: Column) -> Column:
    return F.when((F.col("RVol") > EPS) & (F.col("__n") > 0), x)


feature("RSkew", MID, needs=["RVol", "__r3", "__n"])(lambda: _gated(F.try_divide(F.sqrt("__n") * F.col("__r3"), F.pow("RVol", F.lit(1.5)))))
feature("RKurt", MID, needs=["RVol", "__r4", "__n"])(lambda: _gated(F.try_divide(F.col("__n") * F.col("__r4"), F.col("RVol") * F.col("RVol"))))
feature("UpVolRatio", MID, needs=["RVol", "__up", "__down"])(lambda: F.when(F.col("RVol") > EPS, F.ln((F.col("__up") + EPS) / (F.col("__down") + EPS))))
