"""Index, category, advice and alerts over readings tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysense.constants import AQI_ALERT_THRESHOLD
from skysense.functions import aqi as fn
from skysense.operators.relational import latest_reading
from skysense.series import Series


def with_aqi(df: DataFrame, concentration: str = "pm2_5", *, mode: str = "nullable") -> DataFrame:
    """Adds ``aqi``, ``category`` and ``color``."""
    indexed = df.withColumn("aqi", fn.aqi(F.col(concentration), mode=mode))
    banded = fn.aqi_category(F.col("aqi"))
    return indexed.withColumn("category", banded["category"]).withColumn("color", banded["color"])


def aqi_current(df: DataFrame, s: Series) -> DataFrame:
    """Index of the latest reading of every series; 0 if the table has no PM2.5 column."""
    last = latest_reading(df, s)
    if "pm2_5" not in df.columns:
        last = last.withColumn("aqi", F.lit(0))
    else:
        last = last.withColumn("aqi", fn.aqi(F.col("pm2_5"), mode="strict"))
    banded = fn.aqi_category(F.col("aqi"))
    return (last.withColumn("category", banded["category"]).withColumn("color", banded["color"])
            .withColumn("advice", fn.health_advice(F.col("aqi"))))


def _known(df: DataFrame, mode: str) -> DataFrame:
    """Rows that get an index. Filtering on the index itself would copy its whole
    expression into the scan, once per band."""
    c = F.col("pm2_5")
    if mode == "strict":
        return df
    return df.filter(c.isNotNull() & (c >= 0) if mode == "truncate" else c.isNotNull())


def advice_distribution(df: DataFrame, keys: tuple[str, ...], *, mode: str = "nullable") -> DataFrame:
    """Readings per advice text."""
    indexed = _known(df, mode).select(*keys, fn.aqi(F.col("pm2_5"), mode=mode).alias("aqi"))
    return (indexed.select(*keys, fn.health_advice(F.col("aqi")).alias("advice"))
            .groupBy(*keys, "advice").agg(F.count(F.lit(1)).alias("n")))


def category_distribution(df: DataFrame, keys: tuple[str, ...], *, mode: str = "nullable") -> DataFrame:
    return (with_aqi(_known(df, mode), mode=mode)
            .groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n")))


def aqi_alerts(df: DataFrame, threshold: int = AQI_ALERT_THRESHOLD, *, mode: str = "nullable") -> DataFrame:
    return with_aqi(df, mode=mode).filter(fn.is_alert(F.col("aqi"), threshold))
