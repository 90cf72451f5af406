"""Calendar and cyclic column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour(ts: str | Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: str | Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def is_weekend(ts: str | Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def season(ts: str | Column) -> Column:
    """1 = December-February … 4 = September-November."""
    return F.floor((F.month(ts) % 12 + 3) / 3).cast("int")


def cycle(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position on a cycle."""
    angle = F.lit(2 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def weekday_name(ts: str | Column) -> Column:
    return F.date_format(ts, "EEEE")


def month_name(ts: str | Column) -> Column:
    return F.date_format(ts, "MMMM")
