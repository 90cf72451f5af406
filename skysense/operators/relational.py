"""Projection, filters, order, top-k, joins and unions over readings tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysense.constants import MONTHS, WEEKDAYS
from skysense.series import Series
from skysense.session import join_rows


def filter_valid_ts(df: DataFrame, ts: str = "datetime") -> DataFrame:
    return df.filter(F.col(ts).isNotNull())


def dropna_subset(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Rows in which every given measure is present."""
    return df.na.drop(subset=list(measures))


def dropna_any(df: DataFrame) -> DataFrame:
    return df.na.drop()


def numeric_only(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Numeric columns except the named ones."""
    return df.select(*[f.name for f in df.schema.fields
                       if isinstance(f.dataType, T.NumericType) and f.name not in drop])


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The training columns in training order; those that are missing become 0."""
    have = set(df.columns)
    return df.select(*keep, *[(F.col(c).cast("double") if c in have else F.lit(0.0)).alias(c) for c in features])


def sort_ts(df: DataFrame, s: Series, *, within_partitions: bool = False) -> DataFrame:
    order = [*s.keys, *s.order]
    return df.sortWithinPartitions(*order) if within_partitions else df.orderBy(*order)


def preview(df: DataFrame, s: Series, n: int = 10) -> DataFrame:
    """The first ``n`` rows in time order over all series."""
    return df.orderBy(*s.order, *s.keys).limit(n)


def latest_reading(df: DataFrame, s: Series) -> DataFrame:
    """The last row of every series, as an aggregation with partial results per task."""
    rest = [c for c in df.columns if c not in s.keys]
    # A single number as order keeps this a hash aggregation.
    order = F.struct(*s.order) if s.tiebreak else s.axis(df)
    last = df.groupBy(*s.keys).agg(*[F.max_by(c, order).alias(f"_{i}") for i, c in enumerate(rest)])
    return last.select(*s.keys, *[F.col(f"_{i}").alias(c) for i, c in enumerate(rest)])


def tail_n(df: DataFrame, s: Series, n: int) -> DataFrame:
    """The last ``n`` rows of every series.

    The filter on ``row_number`` is applied before the shuffle as well, so at most
    ``n`` rows per series and task are moved.
    """
    w = Window.partitionBy(*s.keys).orderBy(*[F.desc(c) for c in s.order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def combine_predictions(df: DataFrame, predictions: DataFrame, s: Series, measures: Sequence[str]) -> DataFrame:
    """Readings with one ``{measure}_predicted`` column per measure, joined on series and time.

    ``predictions`` is long: (keys, ts, measure, predicted).
    """
    on = [*s.keys, s.ts]
    wide = predictions.groupBy(*on).agg(
        *[F.max(F.when(F.col("measure") == m, F.col("predicted"))).alias(f"{m}_predicted") for m in measures])
    return join_rows(df, wide, on)


def actual_lookup(predictions: DataFrame, long: DataFrame, s: Series) -> DataFrame:
    """Observed values for predicted rows, joined on series, time and measure."""
    return join_rows(predictions, long, [*s.keys, s.ts, "measure"], "inner")


def append_rows(df: DataFrame, more: DataFrame) -> DataFrame:
    return df.unionByName(more, allowMissingColumns=True)


def history_plus_forecast(df: DataFrame, forecasts: DataFrame, s: Series, measures: Sequence[str],
                          rows: int) -> DataFrame:
    """Last ``rows`` observed values and the forecast as one long table with a ``series`` label."""
    from skysense.operators.shapes import to_long

    past = to_long(tail_n(df, s, rows), measures, [*s.keys, s.ts]).withColumn("series", F.lit("Historical"))
    ahead = forecasts.select(*s.keys, s.ts, "measure", F.col("forecast").alias("value"),
                             F.lit("Forecast").alias("series"))
    return past.unionByName(ahead)


def ordered_dim_join(by_name: DataFrame, names: Sequence[str], name_col: str, *, keep_missing: bool) -> DataFrame:
    """Attach the calendar order of weekday or month names (a fixed list of at most 12).

    With ``keep_missing`` names without data appear with NULLs.
    """
    spark = by_name.sparkSession
    dim = spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"position int, {name_col} string")
    if keep_missing:
        return F.broadcast(dim).join(by_name, name_col, "left")
    return by_name.join(F.broadcast(dim), name_col, "inner")


def weekday_dim(by_name: DataFrame, name_col: str = "weekday") -> DataFrame:
    return ordered_dim_join(by_name, WEEKDAYS, name_col, keep_missing=True)


def month_dim(by_name: DataFrame, name_col: str = "month") -> DataFrame:
    return ordered_dim_join(by_name, MONTHS, name_col, keep_missing=False)


def argmax(value: str | Column, order: Column, *, smallest_first: bool = True) -> Column:
    """The ``value`` with the highest ``order``; ties go to the smallest value."""
    value = F.col(value) if isinstance(value, str) else value
    tie = -value if smallest_first else value
    return F.max_by(value, F.when(order.isNotNull(), F.struct(order, tie)))
