"""Fences, capping and counting of outliers, and checks against valid ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysense.constants import IQR_K_CAP, MIN_POSITIVE, VALID_RANGES
from skysense.functions.numeric import clip, share_pct
from skysense.operators.quantiles import quantiles_wide
from skysense.operators.shapes import per_measure
from skysense.session import attach


def fences(df: DataFrame, measures: Sequence[str], keys: tuple[str, ...] = (), *, method: str = "iqr",
           k: float = IQR_K_CAP, fit_on: Column | None = None, exact: bool = True) -> DataFrame:
    """One row per series with struct ``_fence_{measure}`` (lo, hi).

    ``fit_on`` restricts the rows the fences are learnt from; ``exact=False`` takes the
    quartiles from a sketch.
    """
    if fit_on is not None:
        df = df.filter(fit_on)
    if method == "iqr":
        q = quantiles_wide(df, measures, [0.25, 0.75], keys, exact=exact)

        def bounds(m: str) -> tuple[Column, Column]:
            lo, hi = F.col(f"_q_{m}")[0], F.col(f"_q_{m}")[1]
            return lo - k * (hi - lo), hi + k * (hi - lo)
    elif method == "zscore":
        q = df.groupBy(*keys).agg(*[F.struct(F.avg(m).alias("a"), F.stddev_samp(m).alias("s")).alias(f"_q_{m}")
                                    for m in measures])

        def bounds(m: str) -> tuple[Column, Column]:
            a, s = F.col(f"_q_{m}.a"), F.col(f"_q_{m}.s")
            return a - k * s, a + k * s
    else:
        raise ValueError(f"unknown outlier method {method!r}")

    def fence(m: str) -> Column:
        lo, hi = bounds(m)
        return F.struct(lo.alias("lo"), hi.alias("hi")).alias(f"_fence_{m}")

    return q.select(*keys, *[fence(m) for m in measures])


def cap_outliers(df: DataFrame, measures: Sequence[str], keys: tuple[str, ...] = (), *, method: str = "iqr",
                 k: float = IQR_K_CAP, fit_on: Column | None = None, limits: DataFrame | None = None) -> DataFrame:
    """Move values outside the fences onto them; missing values stay missing.

    ``limits`` is a stored result of ``fences`` to use instead of computing it.
    """
    made = limits if limits is not None else fences(df, measures, keys, method=method, k=k, fit_on=fit_on)
    fenced = attach(df, made, keys, settled=limits is not None)
    capped = {m: clip(F.col(m).cast("double"), F.col(f"_fence_{m}.lo"), F.col(f"_fence_{m}.hi")) for m in measures}
    return fenced.select(*[capped[c].alias(c) if c in capped else F.col(c) for c in df.columns])


def is_outlier(m: str) -> Column:
    return (F.col(m) < F.col(f"_fence_{m}.lo")) | (F.col(m) > F.col(f"_fence_{m}.hi"))


def count_outliers(df: DataFrame, measures: Sequence[str], keys: tuple[str, ...] = (), *, method: str = "iqr",
                   k: float = IQR_K_CAP, limits: DataFrame | None = None) -> DataFrame:
    """Values outside the fences and their share of all rows, per measure."""
    made = limits if limits is not None else fences(df, measures, keys, method=method, k=k)
    fenced = attach(df, made, keys, settled=limits is not None)
    return per_measure(fenced, keys, measures, lambda m: {
        "outliers": F.count_if(is_outlier(m)),
        "outlier_pct": share_pct(F.count_if(is_outlier(m)), F.count(F.lit(1))),
    })


def range_validate(df: DataFrame, measures: Sequence[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Values outside the plausible range, for the measures that have one."""
    known = [m for m in measures if m in VALID_RANGES]

    def stats(m: str) -> dict[str, Column]:
        low, high = VALID_RANGES[m]
        return {"low": F.max(F.lit(low)), "high": F.max(F.lit(high)),
                "out_of_range": F.count_if((F.col(m) < low) | (F.col(m) > high))}

    return per_measure(df, keys, known, stats)


def floor_positive(df: DataFrame, measures: Sequence[str], lowest: float = MIN_POSITIVE) -> DataFrame:
    return df.select(*[clip(c, lower=F.lit(lowest)).alias(c) if c in measures else F.col(c) for c in df.columns])
