"""Time arithmetic that gives the same answer for TIMESTAMP and TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970-01-01."""
    return F.unix_timestamp(ts)


def micros(df: DataFrame, ts: str) -> Column:
    """Exact microseconds since 1970-01-01; zone-free for zone-less timestamps."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        since = F.col(ts) - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        exact = since.cast("interval second").cast("decimal(24,6)")
        return (exact * 1_000_000).cast("long")
    return F.unix_micros(F.col(ts).cast("timestamp"))


def from_seconds(sec: Column) -> Column:
    """TIMESTAMP_NTZ from whole seconds since 1970-01-01."""
    return F.timestamp_add("SECOND", sec.cast("long"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def floor_to(ts: str, step: int, origin: Column | int = 0) -> Column:
    """Start of the ``step``-second bin that holds ``ts``; bins are counted from ``origin``."""
    origin = F.lit(origin) if isinstance(origin, int) else origin
    sec = seconds(ts)
    return from_seconds(sec - F.pmod(sec - origin, F.lit(step)))


def weekday(ts: str) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(ts)
