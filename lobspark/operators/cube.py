"""Figures by every wanted combination of dimensions from one aggregate, over moments that merge.

A moment's state is five sums, so states add up: over rows, over days that were summed before, and over the levels of a cube.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EPS, MORNING_CLOSE
from .evaluate import rank_ic

SUMS = ("n", "s1", "s2", "s3", "s4", "up")


def states(x: Column) -> list[Column]:
    """Aggregates that make a state of a group's values; nulls and NaN aren't counted."""
    x = F.when(~F.isnan(x.cast("double")), x.cast("double"))
    return [F.count(x).alias("n"), *(F.coalesce(F.sum(F.pow(x, F.lit(k))), F.lit(0.0)).alias(f"s{k}") for k in (1, 2, 3, 4)), F.count(F.when(x > 0, 1)).alias("up")]


def merge() -> list[Column]:
    """Aggregates that make one state of many."""
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS]


def figures() -> dict[str, Column]:
    """mean, deviation (population), ratio of both, share above 0, skew and kurtosis of a state; null where undefined."""
    n = F.col("n")
    mean = F.try_divide(F.col("s1"), n)
    square = F.greatest(F.try_divide(F.col("s2"), n) - mean * mean, F.lit(0.0))
    third = F.try_divide(F.col("s3"), n) - 3 * mean * F.try_divide(F.col("s2"), n) + 2 * mean * mean * mean
    fourth = F.try_divide(F.col("s4"), n) - 4 * mean * F.try_divide(F.col("s3"), n) + 6 * mean * mean * F.try_divide(F.col("s2"), n) - 3 * mean * mean * mean * mean
    spread = F.when(square > 1e-18, square)
    return {"mean": mean, "std": F.sqrt(square), "ratio": F.try_divide(mean, F.sqrt(square) + EPS), "win_rate": F.try_divide(F.col("up"), n), "skew": F.try_divide(third, F.pow(spread, F.lit(1.5))), "kurtosis": F.try_divide(fourth, spread * spread)}


def market() -> Column:
    return F.when(F.col("SecurityID").startswith("6"), "sh").otherwise("sz")


def session() -> Column:
    return F.when(F.col("timestamp") <= MORNING_CLOSE, "morning").otherwise("afternoon")


def cube(df: DataFrame, value: Column, dims: list[str], sets: list[list[str]]) -> DataFrame:
    """dims (null where summed over), level (a bit for each dimension that is summed over, the last one the lowest), a
    state and its figures, for each combination of dimensions in sets.

    Values of a dimension must not be null, or they can't be told from a sum but by level. Rows are summed by all dimensions first,
    so the sets multiply groups, not rows.
    """
    finest = df.groupBy(*dims).agg(*states(value))
    out = finest.groupingSets([[F.col(d) for d in s] for s in sets], *dims).agg(F.grouping_id().alias("level"), *merge())
    return out.select(*dims, "level", *SUMS, *[c.alias(n) for n, c in figures().items()])


def ic_cube(df: DataFrame, prediction: str, labels: list[str], min_stocks: int = 10, sets: list[list[str]] | None = None, parts: int | None = None) -> DataFrame:
    """Rank correlations within each market's sections, by market, session and horizon and what sums over them."""
    long = df.select("date", "timestamp", "SecurityID", market().alias("market"), prediction, *labels).unpivot(["date", "timestamp", "SecurityID", "market", prediction], labels, "horizon", "label")
    ics = rank_ic(long, prediction, "label", ["horizon", "market"], min_stocks, parts).withColumn("session", session())
    dims = ["market", "session", "horizon"]
    return cube(ics, F.col("rank_ic"), dims, sets or [dims, ["market", "horizon"], ["session", "horizon"], ["horizon"], []])
