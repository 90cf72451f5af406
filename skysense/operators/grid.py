"""Duplicates, regular grids, resampling and sampling intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysense.functions.timeaxis import floor_to, from_seconds, micros, seconds
from skysense.operators.quantiles import quantiles
from skysense.series import Series, along_rows, neighbours
from skysense.session import join_rows, materialize

HOUR = 3600
DAY = 24 * HOUR
SPAN = 1024  # grid points made from one row of the intermediate spine


def never_null(df: DataFrame, column: str) -> Column:
    """An order by ``column`` with missing values last; a plain number where it is one."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return F.coalesce(F.col(column).cast("long"), F.lit(2**63 - 1))
    return F.struct(F.col(column).isNull(), F.col(column))


def dedupe_first(df: DataFrame, s: Series, seq: str | Sequence[str]) -> DataFrame:
    """Keep the row with the smallest ``seq`` per series and time.

    An aggregation instead of a numbering: copies fold before the shuffle, however
    many rows share one time. Rows without ``seq`` come after all others.
    """
    by = [*s.keys, s.ts]
    rest = [c for c in df.columns if c not in by]
    order = never_null(df, seq) if isinstance(seq, str) else F.struct(*seq)
    first = df.groupBy(*by).agg(*[F.min_by(c, order).alias(f"_{i}") for i, c in enumerate(rest)])
    place = {c: F.col(f"_{i}") for i, c in enumerate(rest)}
    return first.select(*[place[c].alias(c) if c in place else F.col(c) for c in df.columns])


def _spine(bounds: DataFrame, keys: Sequence[str], ts: str, step: int) -> DataFrame:
    """All grid times between ``_lo`` and ``_hi`` (microseconds) of each row of ``bounds``.

    Made in two steps with a shuffle between, so that a long series neither builds
    one huge array nor fills one task.
    """
    unit = step * 1_000_000
    n = int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = (bounds.withColumn("_from", F.explode(F.sequence("_lo", "_hi", F.lit(unit * SPAN))))
             .repartition(n, *keys, "_from"))
    last = F.least(F.col("_hi"), F.col("_from") + F.lit(unit * (SPAN - 1)))
    at = F.explode(F.sequence("_from", last, F.lit(unit)))
    points = spans.select(*keys, at.alias("_at"))
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return points.select(*keys, F.timestamp_add("MICROSECOND", F.col("_at"), epoch).alias(ts))


def time_spine(df: DataFrame, s: Series, step: int = HOUR, *, aligned: bool = False) -> DataFrame:
    """Regular times from the first to the last reading of every series.

    The grid starts at the first reading; with ``aligned`` at a multiple of ``step``.
    """
    unit = step * 1_000_000
    x = micros(df, s.ts)
    if aligned:
        x = x - F.pmod(x, F.lit(unit))
    bounds = df.groupBy(*s.keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    return _spine(bounds.filter(F.col("_lo").isNotNull()), s.keys, s.ts, step)


def grid_left_join(df: DataFrame, s: Series, step: int = HOUR, *, aligned: bool = False) -> DataFrame:
    """Readings on a regular grid; missing times become NULL rows, off-grid readings go.

    With ``aligned`` readings are moved to the start of their grid cell first; they
    must be unique per cell.
    """
    if aligned:
        df = df.withColumn(s.ts, floor_to(s.ts, step))
    return join_rows(time_spine(df, s, step, aligned=aligned), df, [*s.keys, s.ts])


def regularize(df: DataFrame, s: Series, measures: Sequence[str], step: int = HOUR, *,
               aligned: bool = False) -> DataFrame:
    """Regular grid with time-weighted interpolation.

    Missing values before the first valid one stay missing, those after the last one
    take its value. Columns other than the measures stay NULL in added rows.
    """
    from skysense.operators.impute import linear_value

    # Stored, because the gaps are looked up in it twice and the join should run once.
    on_grid = materialize(grid_left_join(df, s, step, aligned=aligned))
    near = neighbours(on_grid, s, measures, by="time")
    filled = {m: linear_value(m, leading=False) for m in measures}
    return near.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in on_grid.columns])


def resample_mean(df: DataFrame, s: Series, measures: Sequence[str], step: int, *,
                  keep_hourly: bool = True) -> DataFrame:
    """Mean per bin of ``step`` seconds, with NULL rows for empty bins.

    ``step`` must divide a day (bins count from midnight). Hourly input asked for
    hourly output is returned as it is unless ``keep_hourly`` is off.
    """
    if step == HOUR and keep_hourly:
        return df
    means = (df.groupBy(*s.keys, floor_to(s.ts, step).alias(s.ts))
             .agg(*[F.avg(m).alias(m) for m in measures]))
    return join_rows(time_spine(df, s, step, aligned=True), means, [*s.keys, s.ts])


def daily_counts(df: DataFrame, s: Series) -> DataFrame:
    """Readings per day, including days without any."""
    per_day = df.groupBy(*s.keys, floor_to(s.ts, DAY).alias(s.ts)).agg(F.count(F.lit(1)).alias("n"))
    full = join_rows(time_spine(df, s, DAY, aligned=True), per_day, [*s.keys, s.ts])
    return full.select(*s.keys, F.col(s.ts).alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def gaps(df: DataFrame, s: Series) -> DataFrame:
    """Seconds since the previous reading, NULL for the first."""
    def diff(w) -> list[Column]:
        return [(seconds(s.ts) - seconds(F.lag(s.ts).over(w))).cast("long").alias("gap_seconds")]
    return along_rows(df, s, diff, before=1)


def cadence_profile(df: DataFrame, s: Series, **options) -> DataFrame:
    """Per series: number of intervals, their median, smallest and largest, in seconds.

    ``options`` are those of ``quantiles``, which finds the median without bringing the
    lengths of a hot series, however many differ, to one task.
    """
    made = materialize(gaps(df, s).select(*s.keys, "gap_seconds").filter(F.col("gap_seconds").isNotNull()))
    ends = made.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("intervals"), F.min("gap_seconds").alias("min_seconds"), F.max("gap_seconds").alias("max_seconds"))
    middle = quantiles(made, ["gap_seconds"], [0.5], s.keys, **options).select(*s.keys, F.col("q")[0].alias("median_seconds"))
    found = join_rows(ends, middle, s.keys) if s.keys else ends.join(middle, F.lit(True), "left")
    # Series with a single row have no interval.
    every = df.select(*s.keys).distinct() if s.keys else None
    if every is not None:
        found = join_rows(every, found, s.keys)
    return found.select(*s.keys, F.coalesce("intervals", F.lit(0)).alias("intervals"), "min_seconds", "max_seconds", "median_seconds")


def synth_datetime(df: DataFrame, order: Series, start: str, ts: str = "datetime") -> DataFrame:
    """Hourly times from ``start`` in row order, for tables whose times cannot be read."""
    from skysense.series import POSITION, number_rows

    origin = F.unix_timestamp(F.lit(start).cast("timestamp_ntz"))
    return (number_rows(df, order)
            .withColumn(ts, from_seconds(origin + F.col(POSITION) * HOUR)).drop(POSITION))
