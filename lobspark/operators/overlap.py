"""Theta joins on time: points in intervals, and intervals that overlap, by replication to bins.

A join on inequalities alone would pair all rows of a key. Here time is cut into bins, and rows meet only in equal bins, by a
plain equality join, after which the inequalities are checked.

* Points in intervals: an interval goes to all bins that it touches, a point to its own, so a pair meets once.
* Intervals with intervals: lengths differ, so there are levels of bins, each sixteen times as wide as the one before. A row has the
  lowest level at which it touches two bins at most, and goes to its bins at that level and those higher ones that rows of the
  other side have; a pair meets at the higher level of its two rows, and of the bins that both touch there the one in which
  the later one begins counts. So a row is sent twice a level at most, however long it is. Both sides are written once: levels,
  hot bins and the join read the written rows.

Hot bins (a stock that everybody trades, an opening auction) are dealt out: the rows of the right side in a bin are divided
among as many parts as their number asks for, and the left rows of that bin go to each part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

#: Right rows of a bin in one part.
PART = 2000
#: A level's bins are this many times as wide as those of the one before.
WIDER = 16


def _free(*frames: DataFrame) -> str:
    name = "__bin"
    while any(c.lower().startswith(name) for df in frames for c in df.columns):
        name += "_"
    return name


def _hot(right: DataFrame, keys: list[str], part: int, name: str) -> DataFrame:
    """Keys with more right rows than part, and the number of parts of each."""
    return right.groupBy(*keys).agg(F.count("*").alias(f"{name}n")).where(F.col(f"{name}n") > part).withColumn(f"{name}parts", F.ceil(F.col(f"{name}n") / part).cast("int")).drop(f"{name}n")


def _parted(left: DataFrame, right: DataFrame, keys: list[str], part: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a part number; keys with more right rows than part are divided."""
    parts = _hot(right, keys, part, name)
    many = F.coalesce(F.col(f"{name}parts"), F.lit(1))
    drawn = F.pmod(F.xxhash64(*[c for c in right.columns if c not in keys]), many).cast("int")
    left = left.join(parts, keys, "left").withColumn(f"{name}part", F.explode(F.sequence(F.lit(0), many - 1))).drop(f"{name}parts")
    right = right.join(parts, keys, "left").withColumn(f"{name}part", drawn).drop(f"{name}parts")
    return left, right


def _clash(left: DataFrame, right: DataFrame, on: list[str]) -> None:
    both = sorted({c.lower() for c in left.columns if c not in on} & {c.lower() for c in right.columns if c not in on})
    if both:
        raise ValueError(f"columns on both sides: {', '.join(both)}")


def in_band(left: DataFrame, right: DataFrame, on: list[str], low: Column, high: Column, at: Column, width: float, part: int = PART) -> DataFrame:
    """Rows of left with those rows of right of equal keys whose `at` (of right) lies in [low, high] (of left).

    width: of a bin; bins as wide as the usual interval make two or three copies of a left row. Null bounds match nothing.
    Columns must have names of their own.
    """
    _clash(left, right, on)
    n = _free(left, right)
    bin_of = lambda x: F.floor(x / width).cast("long")
    a = left.withColumns({f"{n}low": low.cast("double"), f"{n}high": high.cast("double")}).where(F.col(f"{n}low") <= F.col(f"{n}high"))
    a = a.withColumn(n, F.explode(F.sequence(bin_of(F.col(f"{n}low")), bin_of(F.col(f"{n}high")))))
    b = right.withColumn(f"{n}at", at.cast("double")).where(F.col(f"{n}at").isNotNull()).withColumn(n, bin_of(F.col(f"{n}at")))
    a, b = _parted(a, b, [*on, n], part, n)
    met = a.join(b, [*on, n, f"{n}part"]).where((F.col(f"{n}at") >= F.col(f"{n}low")) & (F.col(f"{n}at") <= F.col(f"{n}high")))
    return met.select(*left.columns, *[c for c in right.columns if c not in on])


def overlapping(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: float, part: int = PART) -> DataFrame:
    """Rows of left and right with equal keys whose spans [begin, end) have a moment in common. Empty and null spans have none.

    width: of the finest bins; about the shortest usual length. Columns must have names of their own.
    """
    _clash(left, right, on)
    n = _free(left, right)

    def spans(df: DataFrame, span: tuple[Column, Column], side: str) -> DataFrame:
        df = df.withColumns({f"{n}{side}begin": span[0].cast("double"), f"{n}{side}end": span[1].cast("double")}).where(F.col(f"{n}{side}begin") < F.col(f"{n}{side}end"))
        length = F.col(f"{n}{side}end") - F.col(f"{n}{side}begin")
        return scratch.written(df.withColumn(f"{n}{side}level", F.greatest(F.lit(0), F.ceil(F.log2(length / width) / math.log2(WIDER))).cast("int")), f"spans-{side}")

    def size(level: str) -> Column:
        return F.lit(width) * F.pow(F.lit(float(WIDER)), F.col(level))

    def levels(df: DataFrame, side: str) -> list[int]:
        return sorted(r[0] for r in df.select(f"{n}{side}level").distinct().collect())  # a row a level

    def binned(df: DataFrame, side: str, others: list[int]) -> DataFrame:
        own = F.col(f"{n}{side}level")
        higher = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > own)
        df = df.withColumn(f"{n}level", F.explode(F.concat(F.array(own), higher)))
        first, last = F.floor(F.col(f"{n}{side}begin") / size(f"{n}level")).cast("long"), (F.ceil(F.col(f"{n}{side}end") / size(f"{n}level")) - 1).cast("long")
        return df.withColumn(n, F.explode(F.sequence(first, F.greatest(first, last))))

    a, b = spans(left, left_span, "l"), spans(right, right_span, "r")
    of_a, of_b = levels(a, "l"), levels(b, "r")
    # a key with few rows in all has no hot bin; only if some key has many are bins counted
    if _hot(b, on, part, n).isEmpty():
        a, b = (df.withColumn(f"{n}part", F.lit(0)) for df in (binned(a, "l", of_b), binned(b, "r", of_a)))
    else:
        a, b = _parted(binned(a, "l", of_b), binned(b, "r", of_a), [*on, f"{n}level", n], part, n)
    met = a.join(b, [*on, f"{n}level", n, f"{n}part"])
    later = F.greatest(f"{n}lbegin", f"{n}rbegin")
    once = (F.col(f"{n}level") == F.greatest(f"{n}llevel", f"{n}rlevel")) & (F.floor(later / size(f"{n}level")).cast("long") == F.col(n))
    met = met.where((F.col(f"{n}lbegin") < F.col(f"{n}rend")) & (F.col(f"{n}rbegin") < F.col(f"{n}lend")) & once)
    return met.select(*left.columns, *[c for c in right.columns if c not in on])
