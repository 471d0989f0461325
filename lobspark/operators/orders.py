"""Aggregates of orders by stock and bucket, and the features of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TICK
from ..functions import timegrid
from ..functions.nulls import clip, count0, div, imbalance, rat, sum0
from ..functions.windows import STOCK, as_of
from .registry import feature
from .trades import KEYS, thresholds

MOST_TICKS = 500.0


def aggregate(orders: DataFrame, grid: DataFrame, days: list[str] | None = None) -> DataFrame:
    """Orders (SecurityID, date, OrderTime or secs, OrderPrice, Balance, OrderBSFlag, OrderType A/D, OrderIndex) by bucket.

    grid: snapshots with secs, BidPrice1, AskPrice1. Depth counts new orders with a price against the best price of their
    own side. A side without orders has null averages. days: all trading days, if they are known.
    """
    if "secs" not in orders.columns:
        orders = orders.withColumn("secs", timegrid.seconds(F.col("OrderTime")))
    amount = F.col("OrderPrice") * F.col("Balance")
    orders = orders.withColumn("timestamp", timegrid.ceil_bucket(F.col("secs")))
    limits = thresholds(orders, amount, days if days is not None else orders.select("date").union(grid.select("date")))
    seen = as_of(orders, grid, "secs", "secs", ["BidPrice1", "AskPrice1"]).join(limits, list(STOCK), "left")
    new, cancel = F.col("OrderType") == "A", F.col("OrderType") == "D"
    side = {"buy": F.col("OrderBSFlag") == "B", "sell": F.col("OrderBSFlag") == "S"}
    large, priced = amount >= F.col("large_thresh"), F.col("OrderPrice") > 0
    best = {"buy": F.col("at_BidPrice1"), "sell": F.col("at_AskPrice1")}
    distance = {"buy": best["buy"] - F.col("OrderPrice"), "sell": F.col("OrderPrice") - best["sell"]}
    seen = seen.withColumns({f"__{s}": clip(F.when(new & side[s] & priced & (best[s] > 0), distance[s] / TICK), -MOST_TICKS, MOST_TICKS) for s in side})
    cells = [count0(new & (F.col("OrderPrice").isNull() | (F.col("OrderPrice") <= 0))).alias("market_order_cnt")]
    for s, is_side in side.items():
        for kind, is_kind in (("new", new), ("cancel", cancel)):
            cells += [
                sum0(amount, is_kind & is_side).alias(f"{kind}_{s}_amt"),
                count0(is_kind & is_side).alias(f"{kind}_{s}_cnt"),
                sum0(amount, is_kind & is_side & large).alias(f"large_{kind}_{s}"),
                count0(is_kind & is_side & large).alias(f"large_{kind}_{s}_cnt"),
            ]
        depth = F.col(f"__{s}")
        cells += [
            sum0(amount, new & is_side & priced).alias(f"__num_{s}"),
            sum0(F.col("Balance"), new & is_side & priced).alias(f"__den_{s}"),
            F.avg(depth).alias(f"avg_depth_{s}"),
            count0(F.abs(depth) <= 1).alias(f"depth_best_{s}"),
            count0(F.abs(depth).between(1.01, 5)).alias(f"depth_near_{s}"),
            count0(F.abs(depth) > 5).alias(f"depth_deep_{s}"),
            F.count(depth).alias(f"depth_total_{s}"),
        ]
    out = seen.groupBy(*KEYS).agg(*cells)
    out = out.withColumns({f"avg_price_new_{s}": div(F.col(f"__num_{s}"), F.col(f"__den_{s}")) for s in side})
    return out.drop(*[f"__{x}_{s}" for x in ("num", "den") for s in side])


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


ORDER = {"source": "orders"}


def _cancel_rate(side: str, prefix: str = "", suffix: str = "_cnt") -> Column:
    cancelled = _zero(f"{prefix}cancel_{side}{suffix}")
    return rat(cancelled, _zero(f"{prefix}new_{side}{suffix}") + cancelled)


_COUNTS = ["new_buy_cnt", "cancel_buy_cnt", "new_sell_cnt", "cancel_sell_cnt"]
feature("CancelRateImb", _COUNTS, **ORDER)(lambda: _cancel_rate("buy") - _cancel_rate("sell"))
for _name, _side in (("Buy", "buy"), ("Sell", "sell")):
    feature(f"{_name}CancelRate", _COUNTS, **ORDER)(lambda s=_side: _cancel_rate(s))
    feature(f"Large{_name}CancelRate", [f"large_{x}" for x in _COUNTS], **ORDER)(lambda s=_side: _cancel_rate(s, "large_"))
for _name, _buy, _sell in (("OrderImb", "new_buy_amt", "new_sell_amt"), ("LargeOrderImb", "large_new_buy", "large_new_sell"), ("LargeCancelImb", "large_cancel_buy", "large_cancel_sell")):
    feature(_name, [_buy, _sell], **ORDER)(lambda b=_buy, s=_sell: imbalance(_zero(b), _zero(s)))


@feature("OrderAggress", ["avg_price_new_buy", "avg_price_new_sell", "mid_price"], **ORDER)
def order_aggress() -> Column:
    mid = F.col("mid_price")
    return div(F.col("avg_price_new_buy") - mid, mid) - div(mid - F.col("avg_price_new_sell"), mid)


@feature("OrderDepthPos", ["avg_depth_buy", "avg_depth_sell"], **ORDER)
def order_depth_pos() -> Column:
    buy, sell = _zero("avg_depth_buy"), _zero("avg_depth_sell")
    return rat(buy - sell, F.abs(buy) + F.abs(sell))


def _depth_share(which: str):
    share = lambda s: rat(_zero(f"depth_{which}_{s}"), _zero(f"depth_total_{s}"))
    return lambda: share("buy") - share("sell")


for _name, _which in (("OrderDepthBestFrac", "best"), ("OrderDepthDeepFrac", "deep")):
    feature(_name, [f"depth_{_which}_{s}" for s in ("buy", "sell")] + ["depth_total_buy", "depth_total_sell"], **ORDER)(_depth_share(_which))


@feature("MarketOrderFrac", ["market_order_cnt", "new_buy_cnt", "new_sell_cnt"], **ORDER)
def market_order_frac() -> Column:
    return rat(_zero("market_order_cnt"), _zero("new_buy_cnt") + _zero("new_sell_cnt"))


@feature("OrderArrivalIntensity", ["new_buy_cnt", "new_sell_cnt"], **ORDER)
def order_arrival_intensity() -> Column:
    return (_zero("new_buy_cnt") + _zero("new_sell_cnt")) / 3.0
