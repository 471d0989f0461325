"""Times of day as seconds, and the three-second grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BUCKET


def _part(text: Column, at: int, kind: str) -> Column:
    return F.substring(text, at, 2).try_cast(kind)


def seconds(text: Column) -> Column:
    """HH:MM:SS[.mmm] as seconds with fraction; null for other text."""
    return _part(text, 1, "int") * 3600 + _part(text, 4, "int") * 60 + F.substring(text, 7, 6).try_cast("double")


def floor_bucket(text: Column) -> Column:
    """Snapshot bucket: whole seconds floored to the grid, milliseconds dropped."""
    return (_part(text, 1, "int") * 3600 + _part(text, 4, "int") * 60 + F.floor(_part(text, 7, "int") / BUCKET) * BUCKET).cast("int")


def ceil_bucket(secs: Column) -> Column:
    """Event bucket (T - 3, T]."""
    return (F.ceil(secs / BUCKET) * BUCKET).cast("int")
