"""Arithmetic with the null, zero and NaN rules of the features; nothing divides outside this module."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rat(a: Column, b: Column) -> Column:
    """a / b where b > 0, else 0.0; a null a stays null."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def imbalance(a: Column, b: Column) -> Column:
    return rat(a - b, a + b)


def div(a: Column, b: Column, when: Column | None = None) -> Column:
    """a / b where the condition holds (b > 0 by default), else null."""
    return F.when((b > 0) if when is None else when, F.try_divide(a, b))


def total(cols: list[Column]) -> Column:
    """Sum; null if any part is."""
    return reduce(lambda x, y: x + y, cols)


def total0(cols: list[Column]) -> Column:
    """Sum that ignores nulls."""
    return total([F.coalesce(x, F.lit(0.0)) for x in cols])


def sum0(x: Column, where: Column | None = None) -> Column:
    """Conditional sum in an aggregate; 0 over no rows."""
    zero = F.lit(0.0)
    return F.coalesce(F.sum(x if where is None else F.when(where, x)), zero)


def count0(where: Column) -> Column:
    return F.count(F.when(where, F.lit(1)))


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def floor0(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def nearest_quantile(x: Column, q: float) -> Column:
    """Nearest-rank quantile of a group, exact: element floor(q * (n - 1) + 0.5) of the sorted values.

    Grouped values are a stock's trades of one day, thousands of numbers.
    """
    values = F.array_sort(F.collect_list(x))
    return F.try_element_at(values, (F.floor(F.lit(q) * (F.size(values) - 1) + 0.5) + 1).cast("int"))
