"""Features of price limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import WIDE_LIMIT_PREFIXES
from ..functions.nulls import div, total
from ..functions.windows import first_of_day
from .book import ASK, ASK_VOL, BID, BID_VOL, at, levels, names
from .registry import feature

COLUMNS = ["SecurityID", "PreCloPrice", "LastPrice", *names(1, BID, ASK, BID_VOL, ASK_VOL), "HighLimitPrice", "LowLimitPrice"]


def _limit(native: str, sign: int) -> Column:
    """The exchange's limit price, or an estimate from the previous close and the board's rate."""
    wide = total_or([F.col("SecurityID").startswith(p) for p in WIDE_LIMIT_PREFIXES])
    rate = F.when(wide, F.lit(0.20)).otherwise(F.lit(0.10))
    return F.coalesce(F.col(native), F.round(F.col("PreCloPrice") * (1.0 + sign * rate), 2))


def total_or(conditions: list[Column]) -> Column:
    out = conditions[0]
    for x in conditions[1:]:
        out = out | x
    return out


feature("__high", COLUMNS, helper=True)(lambda: _limit("HighLimitPrice", 1))
feature("__low", COLUMNS, helper=True)(lambda: _limit("LowLimitPrice", -1))


def _gone(side: str) -> Column:
    return at(side).isNull() | (at(side) <= 0)


@feature("__sealed_up", COLUMNS, needs=["__high"], helper=True)
def sealed_up() -> Column:
    return _gone(ASK) & (at(BID) > 0) & (F.abs(at(BID) - F.col("__high")) < 0.005)


@feature("__sealed_down", COLUMNS, needs=["__low"], helper=True)
def sealed_down() -> Column:
    return _gone(BID) & (at(ASK) > 0) & (F.abs(at(ASK) - F.col("__low")) < 0.005)


@feature("LimitUpDist", COLUMNS, needs=["__high"])
def limit_up_dist() -> Column:
    return div(F.col("__high") - F.col("LastPrice"), F.col("__high"))


@feature("LimitDownDist", COLUMNS, needs=["__low"])
def limit_down_dist() -> Column:
    return div(F.col("LastPrice") - F.col("__low"), F.col("LastPrice"))


for _name, _side in (("Up", "up"), ("Down", "down")):
    feature(f"IsLimit{_name}", COLUMNS, needs=[f"__sealed_{_side}"])(lambda s=_side: F.col(f"__sealed_{s}").cast("int"))
    feature(f"IsGapLimit{_name}", COLUMNS, needs=[f"__sealed_{_side}"])(lambda s=_side: (F.col(f"__sealed_{s}") & first_of_day(F.col(f"__sealed_{s}"))).cast("int"))


@feature("LimitBlockAmt", COLUMNS, needs=["__sealed_up", "__sealed_down"])
def limit_block_amt() -> Column:
    return F.when(F.col("__sealed_up"), at(BID_VOL) * at(BID)).when(F.col("__sealed_down"), at(ASK_VOL) * at(ASK)).otherwise(F.lit(0.0))


@feature("__near_up", COLUMNS, needs=["__high", "__sealed_up", "LimitUpDist"], helper=True)
def near_up() -> Column:
    return ~F.col("__sealed_up") & (F.col("LastPrice") > 0) & (F.col("__high") > 0) & (F.col("LimitUpDist") < 0.02)


@feature("__near_down", COLUMNS, needs=["__low", "__sealed_down", "LimitDownDist"], helper=True)
def near_down() -> Column:
    return ~F.col("__sealed_down") & (F.col("LastPrice") > 0) & (F.col("__low") > 0) & (F.col("LimitDownDist") < 0.02)


feature("NearLimitUp", COLUMNS, needs=["__near_up"])(lambda: F.col("__near_up").cast("int"))
feature("NearLimitDown", COLUMNS, needs=["__near_down"])(lambda: F.col("__near_down").cast("int"))


def _scarcity(near: str, side: str) -> Column:
    own, both = total(levels(side, 3)), total(levels(BID_VOL, 3)) + total(levels(ASK_VOL, 3))
    return F.when(F.col(near) & (both > 0), 1.0 - own / both).otherwise(F.lit(0.0))


feature("LimitAskScarcity", [*COLUMNS, *names(3, BID_VOL, ASK_VOL)], needs=["__near_up"])(lambda: _scarcity("__near_up", ASK_VOL))
feature("LimitBidScarcity", [*COLUMNS, *names(3, BID_VOL, ASK_VOL)], needs=["__near_down"])(lambda: _scarcity("__near_down", BID_VOL))
