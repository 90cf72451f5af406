"""Air-quality index as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysense.constants import (
    AQI_ALERT_THRESHOLD, AQI_CATEGORIES, AQI_OUT_OF_TABLE, HEALTH_ADVICE, PM25_BREAKPOINTS,
)


def aqi(concentration: Column, measure: str = "pm2_5", *, mode: str = "strict") -> Column:
    """Index for a concentration; NULL for measures without a breakpoint table.

    ``mode="strict"``: every value that no band holds, including those in the gaps
    between bands, negative and missing ones, yields 500.
    ``mode="nullable"``: the same, but a missing value yields NULL.
    ``mode="truncate"``: the value is first cut to one decimal, which closes the
    gaps as the public definition of the index intends; negative yields NULL.
    """
    if measure != "pm2_5":
        return F.lit(None).cast("int")
    # Bounds as BIGINT tenths would not accept 12.05 -> 500; comparisons stay on doubles.
    c = F.floor(concentration * 10 + 1e-9) / 10 if mode == "truncate" else concentration
    index = None
    for low, high, index_low, index_high in PM25_BREAKPOINTS:
        slope = (index_high - index_low) / (high - low)
        value = F.bround(F.lit(slope) * (c - F.lit(low)) + F.lit(float(index_low))).cast("int")
        inside = (c >= low) & (c <= high)
        index = F.when(inside, value) if index is None else index.when(inside, value)
    index = index.otherwise(F.lit(AQI_OUT_OF_TABLE))
    if mode == "strict":
        return index
    if mode == "truncate":
        return F.when(c >= 0, index)
    return F.when(concentration.isNotNull(), index)


def _banded(index: Column, bands, pick) -> Column:
    out = None
    for band in bands:
        test = F.lit(True) if band[0] is None else index <= band[0]
        out = F.when(test, pick(band)) if out is None else out.when(test, pick(band))
    return F.when(index.isNotNull(), out)


def aqi_category(index: Column) -> Column:
    """Struct (category, color)."""
    return _banded(index, AQI_CATEGORIES,
                   lambda b: F.struct(F.lit(b[1]).alias("category"), F.lit(b[2]).alias("color")))


def health_advice(index: Column) -> Column:
    return _banded(index, HEALTH_ADVICE, lambda b: F.lit(b[1]))


def is_alert(index: Column, threshold: int = AQI_ALERT_THRESHOLD) -> Column:
    return index > threshold
