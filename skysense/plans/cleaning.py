"""Cleaning an unfamiliar table, preparing an upload, and preparing training data."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysense.constants import DATETIME_NAME_PARTS_UPLOAD, IQR_K_CAP, MEASURES
from skysense.operators import schema
from skysense.operators.grid import HOUR, dedupe_first, regularize, resample_mean, synth_datetime
from skysense.operators.impute import fill_missing, impute_smart, interpolate
from skysense.operators.outliers import cap_outliers, count_outliers, fences, range_validate
from skysense.operators.relational import filter_valid_ts
from skysense.operators.scaling import normalize, scaler_params, split_time
from skysense.series import Series
from skysense.session import materialize, settle
from skysense.sources.readings import normalise, project_measures


class Cleaned(NamedTuple):
    data: DataFrame
    log: DataFrame


def _with_time(df: DataFrame, ts: str) -> DataFrame:
    """Parse the time column found by name; without one the first column is tried. Fails if
    no format reads most of it: a table without times can't be cleaned along them."""
    column = schema.column_named_like_time(df.columns) or df.columns[0]
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        raise ValueError(f"there is no time column among {', '.join(df.columns)}")
    if isinstance(kind, T.StringType):
        parsed = schema.parse_datetime(df, column, ts, strict=True)
    else:
        parsed = normalise(df, column).withColumnRenamed(column, ts)
    return parsed.drop(column) if column != ts else parsed


def clean(df: DataFrame, s: Series, seq: str, *, missing: str = "smart", step: int | None = HOUR,
          outlier: str | None = "iqr", k: float = IQR_K_CAP, measures: Sequence[str] = MEASURES) -> Cleaned:
    """Parse times, name the measures, remove duplicates, fill, cap and put on a regular grid.

    ``seq`` is the column that gives the order of the input rows. ``missing`` is
    ``"smart"``, ``"interpolate"``, ``"forward_fill"`` or ``"median"``; ``outlier`` ``"iqr"``,
    ``"zscore"`` or None; ``step`` the grid in seconds or None. The stages are
    stored where the next one reads them more than once.
    """
    timed = filter_valid_ts(_with_time(df, s.ts), s.ts)
    named = schema.map_measure_cols(timed)
    present = [m for m in measures if m in named.columns]
    keep = project_measures(named, s.ts, present).columns
    rows = named.select(*keep, *[c for c in (*s.keys, seq) if c not in keep])
    unique = materialize(dedupe_first(rows, s, seq).drop(seq))

    if missing == "smart":
        filled = impute_smart(unique, s, present)
    else:
        filled = fill_missing(unique, s, present, missing)
    filled = materialize(filled)
    capped = filled
    if outlier:
        # Capping is a projection over the stored rows; it isn't worth a copy of its own.
        limits = settle(fences(filled, present, s.keys, method=outlier, k=k))
        capped = cap_outliers(filled, present, s.keys, limits=limits)
    regular = regularize(capped, s, present, step) if step else capped

    def count(d: DataFrame, order: int, action: str, detail: str) -> DataFrame:
        return d.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(order).alias("step"), F.lit(action).alias("action"), F.lit(detail).alias("detail"), "n")

    def holes(d: DataFrame, order: int, action: str) -> DataFrame:
        cells = sum((F.count_if(F.col(m).isNull()) for m in present[1:]), F.count_if(F.col(present[0]).isNull()))
        return d.agg(cells.alias("n")).select(
            F.lit(order).alias("step"), F.lit(action).alias("action"), F.lit("missing values").alias("detail"), "n")

    parts = [count(timed, 1, "parse_datetime", "rows with a valid time"),
             count(unique, 2, "dedupe", "rows after duplicate removal"),
             holes(unique, 3, "impute_before"), holes(filled, 4, "impute_after")]
    if outlier:
        capped_n = count_outliers(filled, present, s.keys, limits=limits)
        parts.append(capped_n.groupBy("measure").agg(F.sum("outliers").alias("n")).select(
            F.lit(5).alias("step"), F.lit("cap_outliers").alias("action"), F.col("measure").alias("detail"), "n"))
    parts.append(count(regular, 6, "regularize", "rows on the regular grid"))
    issues = range_validate(regular, present)
    parts.append(issues.select(F.lit(7).alias("step"), F.lit("range_check").alias("action"),
                               F.col("measure").alias("detail"), F.col("out_of_range").alias("n")))
    log = parts[0]
    for p in parts[1:]:
        log = log.unionByName(p)
    return Cleaned(regular, log)


def _upload_time(df: DataFrame, s: Series, seq: str | None, start: str) -> DataFrame:
    """The column named like a date or time. Where there is none, or a value in it can't be
    read, rows get hours from ``start`` on in their order."""
    column = schema.column_named_like_time(df.columns, DATETIME_NAME_PARTS_UPLOAD)
    if column:
        if not isinstance(df.schema[column].dataType, (T.StringType, T.NumericType)):
            timed = normalise(df, column).withColumnRenamed(column, s.ts)
            return filter_valid_ts(timed, s.ts)
        which = schema.readable_format(df, column)
        if which is not None:
            timed = schema.parse_with(df, column, which, s.ts)
            return filter_valid_ts(timed.drop(column) if column != s.ts else timed, s.ts)
        df = df.drop(column)
    # The order of the files stands in for a column that numbers the rows.
    rows = df if seq else df.withColumn("_row", F.monotonically_increasing_id())
    order = Series(keys=s.keys, ts=seq or "_row", chunk=1_000_000, block=s.block)
    return synth_datetime(rows, order, start, s.ts).drop("_row")


def prepare_upload(df: DataFrame, s: Series, *, measures: Sequence[str] = MEASURES, seq: str | None = None,
                   start: str | None = None) -> DataFrame:
    """Parse times, keep known columns, interpolate by position and cap at three quartile ranges.

    Tables without readable times get an hourly axis from ``start`` (by default now) in the
    order of ``seq``, or of the files; no row goes.
    """
    timed = _upload_time(df, s, seq, start or datetime.now().strftime("%Y-%m-%d %H:00:00"))
    present = [m for m in measures if m in timed.columns]
    keep = project_measures(timed, s.ts, present).columns
    rows = materialize(timed.select(*keep, *[c for c in (*s.keys, *s.tiebreak) if c not in keep]))
    return cap_outliers(materialize(interpolate(rows, s, present, by="row")), present, s.keys)


class Prepared(NamedTuple):
    data: DataFrame
    params: DataFrame | None


def prepare_training(df: DataFrame, s: Series, measures: Sequence[str], *, method: str = "interpolate",
                     step: int = HOUR, scale: str | None = "minmax", fit_on_train: bool = False) -> Prepared:
    """Fill, cap, resample, split by position and scale by the training rows' parameters.

    The fences come from all rows; ``fit_on_train`` learns them from the training part
    only.
    """
    filled = materialize(fill_missing(df, s, measures, method))
    if fit_on_train:
        filled = materialize(split_time(filled, s, label="_part"))
        capped = cap_outliers(filled, measures, s.keys, fit_on=F.col("_part") == "train").drop("_part")
    else:
        capped = cap_outliers(filled, measures, s.keys)
    split = materialize(split_time(materialize(resample_mean(capped, s, measures, step)), s))
    if scale is None:
        return Prepared(split, None)
    params = scaler_params(split.filter(F.col("split") == "train"), measures, s.keys, method=scale)
    return Prepared(normalize(split, params, measures, s.keys), params)
