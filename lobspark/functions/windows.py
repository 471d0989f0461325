"""Window specifications and what is built on them: moving averages, rolling sums, forward fill, as-of joins, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import EMA_SPAN
from . import timegrid

STOCK = ("SecurityID", "date")
SECTION = ("date", "timestamp")


def stock_window() -> WindowSpec:
    """A stock's day in time order. All features share this one, so Catalyst plans one exchange and one sort."""
    return Window.partitionBy(*STOCK).orderBy("timestamp")


def section_window() -> WindowSpec:
    return Window.partitionBy(*SECTION)


def lag(x: Column, k: int = 1) -> Column:
    return F.lag(x, k).over(stock_window())


def lead(x: Column, k: int) -> Column:
    return F.lead(x, k).over(stock_window())


def first_of_day(x: Column) -> Column:
    return F.first(x).over(stock_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def ema(x: Column, span: int = EMA_SPAN) -> Column:
    """Exponential moving average, y0 = x0, y = a x + (1 - a) y', in closed form over one running sum.

    (1 - a) ** -n overflows a double beyond 7,000 rows; a day has at most 6,601 buckets. x must not be null.
    """
    a = 2.0 / (span + 1)
    n = F.row_number().over(stock_window()) - 1
    weight = F.pow(F.lit(1 - a), n.cast("double"))
    part = F.when(n == 0, x).otherwise(x * a) / weight
    return F.sum(part).over(stock_window().rowsBetween(Window.unboundedPreceding, 0)) * weight


#: Digits behind the point of scaled values in running sums, of 38 in all; sums of a day's rows stay below 100,000.
SUM_DIGITS = 33


def largest(x: Column) -> Column:
    """The largest absolute value of a stock's day; 1 where that is 0 or null."""
    most = F.max(F.abs(x)).over(stock_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(most > 0, most).otherwise(F.lit(1.0))


def rolling(x: Column, rows: int) -> Column:
    """Sum over the last rows rows, nulls as 0, of values between -1 and 1: the difference of two running sums, so a row costs the
    same however long the frame is, and both are frames of one window. The sums are decimals and so is their difference:
    nothing cancels, however large a value has left the frame."""
    whole = stock_window().rowsBetween(Window.unboundedPreceding, 0)
    before = stock_window().rowsBetween(Window.unboundedPreceding, -rows)
    x = F.coalesce(x, F.lit(0.0)).cast(f"decimal(38,{SUM_DIGITS})")
    return (F.sum(x).over(whole) - F.coalesce(F.sum(x).over(before), F.lit(0))).cast("double")


def stream_window() -> WindowSpec:
    """The rows of a stock's day up to each one, in the order of stream(); the bucket grows with the time, so it changes no order, and
    windows over a bucket need no other sort."""
    return Window.partitionBy(*STOCK).orderBy("__bucket", "__secs", "__side", "__turn").rowsBetween(Window.unboundedPreceding, 0)


def stream(events: DataFrame, book: DataFrame, event_secs: str, book_secs: str, carry: list[str], turn: str | None = None) -> DataFrame:
    """Events (columns in __event) and book rows as one stream of each stock's day, with the latest book row as __last.

    A book row comes before events of its time; events of one time are in the order of turn. The book row is carried on as
    a whole (a null price of the latest book isn't replaced by an older one). Whatever else needs the events' order can
    use stream_window() at the price of no further sort.
    """
    key = [F.col(k) for k in STOCK]
    book_part = book.select(*key, F.col(book_secs).alias("__secs"), F.lit(0).alias("__side"), F.lit(0).cast("long").alias("__turn"), F.struct(*carry).alias("__book"))
    order = F.col(turn).cast("long") if turn else F.lit(0).cast("long")
    event_part = events.withColumn("__event", F.struct(*[x for x in events.columns if x not in STOCK])).select(*key, F.col(event_secs).alias("__secs"), F.lit(1).alias("__side"), order.alias("__turn"), "__event")
    both = book_part.unionByName(event_part, allowMissingColumns=True).withColumn("__bucket", timegrid.ceil_bucket(F.col("__secs")))
    return both.withColumn("__last", F.last("__book", ignorenulls=True).over(stream_window()))


def as_of(events: DataFrame, book: DataFrame, event_secs: str, book_secs: str, carry: list[str], prefix: str = "at_") -> DataFrame:
    """Each event with the latest book row of its stock and day at or before it; equal times match.

    Both sides are one stream, sorted once. No pairs are made, whatever the two sizes.
    """
    both = stream(events, book, event_secs, book_secs, carry).where("__side = 1")
    return both.select(*STOCK, "__event.*", *[F.col(f"__last.{x}").alias(prefix + x) for x in carry])
