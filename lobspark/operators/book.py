"""Features of one snapshot: spreads, imbalances and shapes of the book."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TICK
from ..functions.nulls import div, floor0, imbalance, rat, total
from ..functions.windows import lag
from .registry import feature

BID, ASK, BID_VOL, ASK_VOL, BID_N, ASK_N = "BidPrice", "AskPrice", "BidVolume", "AskVolume", "NumOrdersB", "NumOrdersS"


def names(k: int, *kinds: str) -> list[str]:
    return [f"{kind}{i}" for kind in kinds for i in range(1, k + 1)]


def at(kind: str, i: int = 1) -> Column:
    return F.col(f"{kind}{i}")


def levels(kind: str, k: int) -> list[Column]:
    return [at(kind, i) for i in range(1, k + 1)]


def mid() -> Column:
    return (at(BID) + at(ASK)) / 2.0


def both_sides() -> Column:
    return (at(BID) > 0) & (at(ASK) > 0)


@feature("OBI", names(1, BID_VOL, ASK_VOL))
def obi() -> Column:
    return imbalance(at(BID_VOL), at(ASK_VOL))


@feature("Spread", names(1, BID, ASK))
def spread() -> Column:
    return F.when(both_sides(), at(ASK) - at(BID))


@feature("SpreadRel", names(1, BID, ASK))
def spread_rel() -> Column:
    return F.when(both_sides(), (at(ASK) - at(BID)) / mid())


@feature("MicroPrice", names(1, BID, ASK, BID_VOL, ASK_VOL))
def micro_price() -> Column:
    volume = at(BID_VOL) + at(ASK_VOL)
    return div(at(ASK) * at(BID_VOL) + at(BID) * at(ASK_VOL), volume, both_sides() & (volume > 0))


@feature("MicroPriceBias", names(1, BID, ASK, BID_VOL, ASK_VOL), needs=["MicroPrice"])
def micro_price_bias() -> Column:
    return div(F.col("MicroPrice"), mid(), both_sides()) - 1


def _order_counts(k: int):
    return lambda: imbalance(total(levels(BID_N, k)), total(levels(ASK_N, k)))


def _volumes(k: int):
    return lambda: imbalance(total(levels(BID_VOL, k)), total(levels(ASK_VOL, k)))


def _amounts(k: int):
    amount = lambda price, volume: total([at(volume, i) * at(price, i) for i in range(1, k + 1)])
    return lambda: imbalance(amount(BID, BID_VOL), amount(ASK, ASK_VOL))


for _k in (1, 5, 10):
    feature(f"OCIB_{_k}", names(_k, BID_N, ASK_N))(_order_counts(_k))
for _k in (3, 5, 10):
    feature(f"OBI_{_k}", names(_k, BID_VOL, ASK_VOL))(_volumes(_k))
for _k in (1, 3, 5, 10):
    feature(f"AmtOBI_{_k}", names(_k, BID, ASK, BID_VOL, ASK_VOL))(_amounts(_k))


@feature("Depth_Imbalance", names(5, BID, ASK, BID_VOL, ASK_VOL))
def depth_imbalance() -> Column:
    """Volumes weighted by exp(-distance from the best price in ticks)."""
    far = lambda d: F.exp(-(floor0(d) / TICK))
    bid = total([F.lit(0.0), *(at(BID_VOL, i) * far(at(BID) - at(BID, i)) for i in range(1, 6))])
    ask = total([F.lit(0.0), *(at(ASK_VOL, i) * far(at(ASK, i) - at(ASK)) for i in range(1, 6))])
    return imbalance(bid, ask)


@feature("MaxDurPressure", ["MaxBidDur", "MaxSellDur"])
def max_dur_pressure() -> Column:
    bid, sell = F.col("MaxBidDur") - lag(F.col("MaxBidDur")), F.col("MaxSellDur") - lag(F.col("MaxSellDur"))
    return F.when(F.col("MaxBidDur").isNotNull() & F.col("MaxSellDur").isNotNull(), imbalance(bid, sell))


@feature("Vol_Spread", names(5, BID_VOL, ASK_VOL))
def vol_spread() -> Column:
    bid, ask = total(levels(BID_VOL, 5)), total(levels(ASK_VOL, 5))
    return F.when((bid > 0) & (ask > 0), F.ln(bid / ask))


@feature("DepthConcentration", names(10, BID_VOL, ASK_VOL))
def depth_concentration() -> Column:
    return rat(at(BID_VOL), total(levels(BID_VOL, 10))) - rat(at(ASK_VOL), total(levels(ASK_VOL, 10)))


@feature("TopDepthRatio", names(10, BID_VOL, ASK_VOL))
def top_depth_ratio() -> Column:
    return rat(at(BID_VOL) + at(ASK_VOL), total(levels(BID_VOL, 10)) + total(levels(ASK_VOL, 10)))


def _slope(price: str, volume: str) -> Column:
    """Least-squares slope of cumulative volume on price over five levels."""
    x = levels(price, 5)
    y = [total(levels(volume, i)) for i in range(1, 6)]
    spread_ = 5.0 * total([p * p for p in x]) - total(x) * total(x)
    return div(5.0 * total([p * v for p, v in zip(x, y, strict=True)]) - total(x) * total(y), spread_, F.abs(spread_) > 1e-12)


@feature("BookSlope", names(5, BID, ASK, BID_VOL, ASK_VOL))
def book_slope() -> Column:
    depth = total(levels(BID_VOL, 5)) + total(levels(ASK_VOL, 5))
    return div((-_slope(BID, BID_VOL) - _slope(ASK, ASK_VOL)) * mid(), depth)


def _convexity(price: str, volume: str) -> Column:
    """Change of the volume gathered per price step, from levels 1-3 to levels 3-5, in shares of all volume."""
    step = lambda i, j: F.when(F.abs(at(price, i) - at(price, j)) > 0.009, F.abs(at(price, i) - at(price, j))).otherwise(F.lit(TICK))
    inner, outer = (at(volume, 2) + at(volume, 3)) / step(1, 3), (at(volume, 4) + at(volume, 5)) / step(3, 5)
    return div(outer - inner, total(levels(volume, 5)))


@feature("BookConvexity", names(5, BID, ASK, BID_VOL, ASK_VOL))
def book_convexity() -> Column:
    return _convexity(BID, BID_VOL) - _convexity(ASK, ASK_VOL)


@feature("VWAP_Deviation", names(5, BID, ASK, BID_VOL, ASK_VOL))
def vwap_deviation() -> Column:
    vwap = lambda price, volume: div(total([at(price, i) * at(volume, i) for i in range(1, 6)]), total(levels(volume, 5)))
    return div(vwap(ASK, ASK_VOL) - vwap(BID, BID_VOL), mid())


@feature("AvgOrderSizeImb", names(5, BID_VOL, ASK_VOL, BID_N, ASK_N))
def avg_order_size_imb() -> Column:
    size = lambda volume, count: div(total(levels(volume, 5)), total(levels(count, 5)))
    return imbalance(size(BID_VOL, BID_N), size(ASK_VOL, ASK_N))
