"""Scaling with stored parameters, and the positional split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysense.constants import TEST_SHARE, VALIDATION_SHARE
from skysense.series import POSITION, Series, number_rows
from skysense.session import attach


def scaler_params(df: DataFrame, measures: Sequence[str], keys: tuple[str, ...] = (), *,
                  method: str = "minmax") -> DataFrame:
    """One row per series with struct ``_scale_{measure}`` (shift, width)."""
    def scale(m: str) -> Column:
        if method == "minmax":
            shift, width = F.min(m), F.max(m) - F.min(m)
        elif method == "standard":
            shift, width = F.avg(m), F.stddev_samp(m)
        else:
            raise ValueError(f"unknown scaling method {method!r}")
        return F.struct(shift.cast("double").alias("shift"), width.cast("double").alias("width")).alias(f"_scale_{m}")

    return df.groupBy(*keys).agg(*[scale(m) for m in measures])


def _apply(df: DataFrame, params: DataFrame, measures: Sequence[str], keys: tuple[str, ...], formula) -> DataFrame:
    joined = attach(df, params, keys)
    return joined.select(*[formula(c).alias(c) if c in measures else F.col(c) for c in df.columns])


def normalize(df: DataFrame, params: DataFrame, measures: Sequence[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """``(x - shift) / width``; NULL where the fitted measure was constant."""
    return _apply(df, params, measures, keys, lambda m: F.try_divide(
        F.col(m) - F.col(f"_scale_{m}.shift"), F.col(f"_scale_{m}.width")))


def inverse_normalize(df: DataFrame, params: DataFrame, measures: Sequence[str],
                      keys: tuple[str, ...] = ()) -> DataFrame:
    return _apply(df, params, measures, keys, lambda m:
                  F.col(m) * F.col(f"_scale_{m}.width") + F.col(f"_scale_{m}.shift"))


def split_time(df: DataFrame, s: Series, *, test: float = TEST_SHARE, validation: float = VALIDATION_SHARE,
               label: str = "split") -> DataFrame:
    """Label rows train, val or test by their position in the series; nothing is shuffled at random."""
    numbered = number_rows(df, s, total="_n")
    train_end = F.floor(F.col("_n") * F.lit(1 - test - validation))
    val_end = F.floor(F.col("_n") * F.lit(1 - test))
    part = (F.when(F.col(POSITION) < train_end, "train")
            .when(F.col(POSITION) < val_end, "val").otherwise("test"))
    return numbered.withColumn(label, part).drop(POSITION, "_n")
