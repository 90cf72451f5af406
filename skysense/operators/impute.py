"""Filling missing values along a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysense.operators.quantiles import quantiles_wide
from skysense.series import Series, neighbours
from skysense.session import attach, join_rows


def linear_value(m: str, *, leading: bool = True, trailing: bool = True) -> Column:
    """Value on the line between the neighbouring points; the nearest point at the ends."""
    p, n = f"`_prev_{m}`", f"`_next_{m}`"
    between = f"{p}.v + ({n}.v - {p}.v) * (CAST(_x - {p}.x AS DOUBLE) / CAST(nullif({n}.x - {p}.x, 0) AS DOUBLE))"
    ends = [f"CASE WHEN {p} IS NULL THEN {n}.v END"] if leading else []
    if trailing:
        ends.append(f"CASE WHEN {n} IS NULL THEN {p}.v END")
    return F.expr(f"coalesce({', '.join([f'CAST(`{m}` AS DOUBLE)', between, *ends])})")


def _replace(near: DataFrame, df: DataFrame, values: dict[str, Column]) -> DataFrame:
    return near.select(*[values[c].alias(c) if c in values else F.col(c) for c in df.columns])


def interpolate(df: DataFrame, s: Series, measures: Sequence[str], *, by: str = "time") -> DataFrame:
    """Linear interpolation in elapsed time (``by="time"``) or row position (``by="row"``).

    Missing values at either end take the nearest valid one. A measure without any
    value in a series stays NULL.
    """
    near = neighbours(df, s, measures, by=by)
    return _replace(near, df, {m: linear_value(m) for m in measures})


def forward_fill(df: DataFrame, s: Series, measures: Sequence[str]) -> DataFrame:
    """Last valid value at or before each row."""
    near = neighbours(df, s, measures, by="time", sides=["prev"])
    return _replace(near, df, {m: F.coalesce(F.col(m).cast("double"), F.col(f"_prev_{m}")["v"]) for m in measures})


def median_fill(df: DataFrame, s: Series, measures: Sequence[str]) -> DataFrame:
    """The median of its series for every missing value."""
    medians = quantiles_wide(df, measures, [0.5], s.keys)
    value = {m: F.coalesce(F.col(m).cast("double"), F.col(f"_q_{m}")[0]) for m in measures}
    return _replace(attach(df, medians, s.keys), df, value)


FILLS = {"interpolate": interpolate, "forward_fill": forward_fill, "median": median_fill}


def fill_missing(df: DataFrame, s: Series, measures: Sequence[str], method: str = "interpolate") -> DataFrame:
    """Fill by ``"interpolate"`` (time), ``"forward_fill"`` or ``"median"``, then drop rows that still miss a measure."""
    if method not in FILLS:
        raise ValueError(f"unknown fill method {method!r}; there are {', '.join(FILLS)}")
    return FILLS[method](df, s, measures).na.drop(subset=list(measures))


def impute_smart(df: DataFrame, s: Series, measures: Sequence[str], *, high_missing: float = 0.5) -> DataFrame:
    """Median where more than half of a series' values are missing, else positional interpolation.

    The choice is made per series and measure, with columns and not on the driver.
    """
    rows = df.groupBy(*s.keys).agg(
        *[(F.avg(F.col(m).isNull().cast("int")) > high_missing).alias(f"_sparse_{m}") for m in measures])
    medians = quantiles_wide(df, measures, [0.5], s.keys)
    # The medians have no row for a series without any value; its rates must survive.
    params = join_rows(rows, medians, s.keys) if s.keys else rows.crossJoin(F.broadcast(medians))
    near = attach(neighbours(df, s, measures, by="row"), params, s.keys)

    def value(m: str) -> Column:
        median = F.coalesce(F.col(m).cast("double"), F.col(f"_q_{m}")[0])
        return F.when(F.col(f"_sparse_{m}"), median).otherwise(linear_value(m))

    return _replace(near, df, {m: value(m) for m in measures})
