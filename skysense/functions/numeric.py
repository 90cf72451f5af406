"""Small numeric expressions with one treatment of missing values: NULL in, NULL out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_or_name(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    c = col_or_name(c)
    return F.when(~F.isnan(c), c)


def clip(c: str | Column, lower: Column | None = None, upper: Column | None = None) -> Column:
    """Bound a value; missing values and missing bounds leave it as it is."""
    c = col_or_name(c)
    out = c
    if lower is not None:
        out = F.when(out < lower, lower).otherwise(out)
    if upper is not None:
        out = F.when(out > upper, upper).otherwise(out)
    return out


def share_pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def sample_skewness(c: str | Column) -> Column:
    """Bias-corrected skewness; NULL for fewer than three values or a constant."""
    c = col_or_name(c)
    n = F.count(c).cast("double")
    g1 = F.when(F.count(c) > 2, F.skewness(c))
    return nan_to_null(F.when(F.stddev_pop(c) > 0, g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)))


def pearson(a: str, b: str) -> Column:
    """Correlation over rows where both are present; NULL where one of them is constant."""
    x = F.when(F.col(b).isNotNull(), F.col(a))
    y = F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def coef_variation(c: str | Column) -> Column:
    """Standard deviation in percent of the mean; 0 unless the mean is positive."""
    c = col_or_name(c)
    mean = F.avg(c)
    return F.when(mean > 0, F.try_divide(F.stddev_samp(c), mean) * 100).otherwise(F.lit(0.0))
