"""Lag, rolling, calendar, interaction and sequence features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysense.constants import LAGS, LOOKBACK, RATIO_EPSILON, ROLLING_WINDOWS
from skysense.functions import calendar
from skysense.operators.relational import numeric_only
from skysense.series import POSITION, Series, along_rows, number_rows

ROLLING_STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def lag_exprs(measure: str, lags: Sequence[int], w) -> list[Column]:
    return [F.lag(measure, k).over(w).alias(f"{measure}_lag_{k}") for k in lags]


def rolling_exprs(measure: str, windows: Sequence[int], stats: Sequence[str], w, *,
                  leak_free: bool = False) -> list[Column]:
    """Rolling statistics, NULL until the frame is full and free of NULLs.

    The frame ends at the current row, or with ``leak_free`` at the row before it.
    """
    out = []
    for size in windows:
        frame = w.rowsBetween(-size, -1) if leak_free else w.rowsBetween(1 - size, Window.currentRow)
        full = F.count(measure).over(frame) == size
        out += [F.when(full, ROLLING_STATS[stat](measure).over(frame)).alias(f"{measure}_rolling_{stat}_{size}")
                for stat in stats]
    return out


def lag_features(df: DataFrame, s: Series, measures: Sequence[str], lags: Sequence[int] = LAGS, *,
                 step: int | None = None) -> DataFrame:
    return along_rows(df, s, lambda w: [c for m in measures for c in lag_exprs(m, lags, w)],
                      before=max(lags), step=step)


def rolling_features(df: DataFrame, s: Series, measures: Sequence[str],
                     windows: Sequence[int] = ROLLING_WINDOWS, *, leak_free: bool = False,
                     step: int | None = None) -> DataFrame:
    return along_rows(
        df, s, lambda w: [c for m in measures for c in rolling_exprs(m, windows, tuple(ROLLING_STATS), w,
                                                                     leak_free=leak_free)],
        before=max(windows), step=step)


def time_columns(ts: str | Column) -> list[Column]:
    hour, dow, month = calendar.hour(ts), calendar.day_of_week(ts), F.month(ts)
    out = [hour.alias("hour")]
    out += [c.alias(f"hour_{n}") for n, c in zip(("sin", "cos"), calendar.cycle(hour, 24))]
    out += [dow.alias("day_of_week"), calendar.is_weekend(ts).alias("is_weekend")]
    out += [c.alias(f"dow_{n}") for n, c in zip(("sin", "cos"), calendar.cycle(dow, 7))]
    out += [month.alias("month")]
    out += [c.alias(f"month_{n}") for n, c in zip(("sin", "cos"), calendar.cycle(month, 12))]
    out += [calendar.season(ts).alias("season")]
    return out


TIME_FEATURES = ("hour", "hour_sin", "hour_cos", "day_of_week", "is_weekend", "dow_sin", "dow_cos",
                 "month", "month_sin", "month_cos", "season")


def time_features(df: DataFrame, ts: str = "datetime") -> DataFrame:
    return df.select(*[c for c in df.columns if c not in TIME_FEATURES], *time_columns(ts))


def interaction_columns(columns: Sequence[str]) -> list[Column]:
    out = []
    if "pm2_5" in columns and "pm10" in columns:
        out.append(F.try_divide(F.col("pm2_5"), F.col("pm10") + F.lit(RATIO_EPSILON)).alias("PM_ratio"))
    if "no2" in columns and "o3" in columns:
        out.append((F.col("no2") * F.col("o3")).alias("NO2_O3_interaction"))
    return out


def interaction_features(df: DataFrame) -> DataFrame:
    return df.select("*", *interaction_columns(df.columns))


def all_features(df: DataFrame, s: Series, target: str, *, lags: Sequence[int] = LAGS,
                 windows: Sequence[int] = ROLLING_WINDOWS, step: int | None = None) -> DataFrame:
    """Calendar, lag, rolling and interaction features; rows with any missing value go."""
    def exprs(w) -> list[Column]:
        return [*time_columns(s.ts), *lag_exprs(target, lags, w),
                *rolling_exprs(target, windows, tuple(ROLLING_STATS), w), *interaction_columns(df.columns)]
    return along_rows(df, s, exprs, before=max(*lags, *windows), step=step).na.drop()


def feature_names(target: str, others: Sequence[str], lookback: int = LOOKBACK,
                  windows: Sequence[int] = ROLLING_WINDOWS) -> list[str]:
    """Feature columns of ``supervised_features`` in training order."""
    rolling = [f"{target}_rolling_{stat}_{w}" for w in windows if w <= lookback for stat in ("mean", "std")]
    return [*others, *[f"{target}_lag_{k}" for k in range(1, lookback + 1)], *rolling, *TIME_FEATURES]


def supervised_features(df: DataFrame, s: Series, target: str, *, lookback: int = LOOKBACK,
                        leak_free: bool = False, step: int | None = None) -> DataFrame:
    """Series keys, time, target and the numeric feature columns; incomplete rows go.

    Default frames include the current target value, and the other measures of the
    same hour are features. ``leak_free`` ends the frames one row earlier and lags
    the other measures by one row.
    """
    others = [c for c in numeric_only(df, drop=[*s.keys, s.ts, *s.tiebreak, target]).columns
              if c not in TIME_FEATURES]
    windows = [w for w in ROLLING_WINDOWS if w <= lookback]
    slim = df.select(*s.keys, *s.order, target, *others)

    def exprs(w) -> list[Column]:
        out = [*lag_exprs(target, range(1, lookback + 1), w),
               *rolling_exprs(target, windows, ("mean", "std"), w, leak_free=leak_free), *time_columns(s.ts)]
        if leak_free:
            out += [F.lag(o).over(w).alias(f"_past_{o}") for o in others]
        return out

    rows = along_rows(slim, s, exprs, before=max([lookback, *windows]), step=step)
    if leak_free:
        rows = rows.drop(*others).withColumnsRenamed({f"_past_{o}": o for o in others})
    names = feature_names(target, others, lookback)
    return rows.select(*s.keys, s.ts, target, *names).na.drop()


def other_measures(df: DataFrame, s: Series, target: str) -> list[str]:
    return [c for c in numeric_only(df, drop=[*s.keys, s.ts, *s.tiebreak, target]).columns if c not in TIME_FEATURES]


def wide_features(df: DataFrame, s: Series, targets: Sequence[str], *, lookback: int = LOOKBACK,
                  step: int | None = None) -> DataFrame:
    """``df`` with the features of all ``targets``, made along the rows once; incomplete rows stay."""
    windows = [w for w in ROLLING_WINDOWS if w <= lookback]
    slim = df.select(*dict.fromkeys([*s.keys, *s.order, *targets, *other_measures(df, s, "")]))

    def exprs(w) -> list[Column]:
        own = [c for m in targets for c in (*lag_exprs(m, range(1, lookback + 1), w),
                                            *rolling_exprs(m, windows, ("mean", "std"), w))]
        return [*own, *time_columns(s.ts)]

    return along_rows(slim, s, exprs, before=max([lookback, *windows]), step=step)


def features_of(wide: DataFrame, df: DataFrame, s: Series, target: str, lookback: int = LOOKBACK) -> DataFrame:
    """What ``supervised_features`` of ``df`` gives for ``target``, from its ``wide_features``."""
    names = feature_names(target, other_measures(df, s, target), lookback)
    return wide.select(*s.keys, s.ts, target, *names).na.drop()


def sequence_windows(df: DataFrame, s: Series, target: str, columns: Sequence[str], *, lookback: int = LOOKBACK,
                     horizon: int = 1, step: int | None = None) -> DataFrame:
    """Per usable row: ``X``, the ``lookback`` preceding rows of ``columns``, and ``y``,
    the target ``horizon - 1`` rows ahead."""
    def exprs(w) -> list[Column]:
        past = F.collect_list(F.array(*[F.col(c).cast("double") for c in columns]))
        return [past.over(w.rowsBetween(-lookback, -1)).alias("_X"),
                F.lead(target, horizon - 1).over(w).alias("_y"),
                F.lead(F.lit(1), horizon - 1).over(w).alias("_has_y")]

    slim = df.select(*dict.fromkeys([*s.keys, *s.order, target, *columns]))
    rows = along_rows(slim, s, exprs, before=lookback, after=horizon - 1, step=step)
    usable = (F.size("_X") == lookback) & F.col("_has_y").isNotNull()
    return rows.filter(usable).select(*s.keys, s.ts, F.col("_X").alias("X"), F.col("_y").alias("y"))


def half_trend(df: DataFrame, s: Series, value: str) -> DataFrame:
    """Mean of the second half of each series against the first half."""
    first = F.col(POSITION) < F.floor(F.col("_n") / 2)
    halves = number_rows(df, s, total="_n").groupBy(*s.keys).agg(
        F.avg(F.when(first, F.col(value))).alias("first_half"),
        F.avg(F.when(~first, F.col(value))).alias("second_half"))
    change = F.try_divide(F.col("second_half") - F.col("first_half"), F.col("first_half")) * 100
    named = halves.withColumn("change_pct", change)
    direction = F.when(F.col("change_pct") > 20, "increasing").when(F.col("change_pct") < -20, "decreasing")
    return named.withColumn("direction", direction)
