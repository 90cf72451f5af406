"""Wide and long form of a readings table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, measures: Sequence[str], keep: Sequence[str] = (), *,
            name: str = "measure", value: str = "value") -> DataFrame:
    """One row per (row, measure); NULL values stay."""
    wide = df.select(*keep, *[F.col(m).cast("double").alias(m) for m in measures])
    return wide.unpivot(list(keep), list(measures), name, value)


def per_measure(df: DataFrame, keys: Sequence[str], measures: Sequence[str], stats, *,
                name: str = "measure") -> DataFrame:
    """Aggregate every measure in one pass over ``df`` and return one row per measure.

    ``stats(m)`` maps output names to aggregate columns for measure ``m``.
    """
    names = list(stats(measures[0]))
    wide = df.groupBy(*keys).agg(*[F.struct(*[c.alias(n) for n, c in stats(m).items()]).alias(f"_{i}")
                                   for i, m in enumerate(measures)])
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_{i}").alias("s"))
                     for i, m in enumerate(measures)])
    long = wide.select(*keys, F.explode(rows).alias("r"))
    return long.select(*keys, F.col("r.measure").alias(name), *[F.col(f"r.s.{n}").alias(n) for n in names])


def measure_order(measures: Sequence[str], col: str = "measure"):
    """Position of a measure name in the configured order."""
    return F.array_position(F.array(*[F.lit(m) for m in measures]), F.col(col)).cast("int")
