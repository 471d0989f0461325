"""Order-flow imbalance: what joined or left the book since the previous snapshot of the stock's day."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.nulls import rat, total, total0
from ..functions.windows import ema, lag
from .book import ASK, ASK_VOL, BID, BID_VOL, at, levels, names
from .registry import feature


def bid_flow(i: int) -> Column:
    price, volume = at(BID, i), at(BID_VOL, i)
    before, held = lag(price), lag(volume)
    return F.when(price > before, volume).when(price == before, volume - held).when(price < before, -held).otherwise(F.lit(0.0))


def ask_flow(i: int) -> Column:
    price, volume = at(ASK, i), at(ASK_VOL, i)
    before, held = lag(price), lag(volume)
    return F.when(price > before, -held).when(price == before, volume - held).when(price < before, volume).otherwise(F.lit(0.0))


for _i in range(1, 11):
    feature(f"__flow{_i}", [f"{k}{_i}" for k in (BID, ASK, BID_VOL, ASK_VOL)], helper=True)(lambda i=_i: bid_flow(i) - ask_flow(i))


@feature("OFI_1", names(1, BID, ASK, BID_VOL, ASK_VOL), needs=["__flow1"])
def ofi_1() -> Column:
    return rat(F.col("__flow1"), at(BID_VOL) + at(ASK_VOL))


def _ofi(k: int):
    flows = lambda: [F.col(f"__flow{i}") for i in range(1, k + 1)]
    return lambda: rat(total0(flows()), total0(levels(BID_VOL, k) + levels(ASK_VOL, k)))


for _name, _k in (("OFI_3", 3), ("OFI", 5), ("OFI_10", 10)):
    feature(_name, names(_k, BID, ASK, BID_VOL, ASK_VOL), needs=[f"__flow{i}" for i in range(1, _k + 1)])(_ofi(_k))


@feature("TS_Imbalance", names(1, BID, ASK, BID_VOL, ASK_VOL))
def ts_imbalance() -> Column:
    e, f = bid_flow(1), ask_flow(1)
    return rat(e - f, F.abs(e) + F.abs(f))


@feature("OFI_MA", needs=["OFI"])
def ofi_ma() -> Column:
    return ema(F.col("OFI"))


@feature("__ofi_var", needs=["OFI", "OFI_MA"], helper=True)
def ofi_variance() -> Column:
    return ema(F.pow(F.col("OFI") - F.col("OFI_MA"), F.lit(2.0)))


@feature("OFI_Z", needs=["OFI", "OFI_MA", "__ofi_var"])
def ofi_z() -> Column:
    deviation = F.sqrt(F.greatest(F.col("__ofi_var"), F.lit(0.0)))
    return F.when(deviation > 1e-8, F.try_divide(F.col("OFI") - F.col("OFI_MA"), deviation)).otherwise(F.lit(0.0))


@feature("OFI_Decay", needs=["OFI"])
def ofi_decay() -> Column:
    now = lambda k: F.col("OFI") if not k else lag(F.col("OFI"), k)
    return total([F.coalesce(now(k), F.lit(0.0)) * exp(-k) for k in range(5)])


