"""Errors, metrics, insights and simple forecasts over prediction tables.

Predictions are long: (keys, ts, measure, actual, predicted).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysense.constants import RATIO_EPSILON
from skysense.functions.timeaxis import from_seconds, seconds
from skysense.operators.features import half_trend
from skysense.operators.grid import HOUR
from skysense.operators.quantiles import quantiles
from skysense.operators.relational import latest_reading
from skysense.operators.shapes import to_long
from skysense.series import Series, along_rows
from skysense.session import attach


def persistence(df: DataFrame, s: Series, measures: Sequence[str], *, step: int | None = None) -> DataFrame:
    """Baseline predictions: every value is predicted to equal the one before it."""
    lagged = along_rows(df, s, lambda w: [F.lag(m).over(w).alias(f"_p_{m}") for m in measures],
                        before=1, step=step)
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("actual"), F.col(f"_p_{m}").alias("predicted"))
                     for m in measures])
    long = lagged.select(*s.keys, s.ts, F.inline(rows))
    return long.filter(F.col("actual").isNotNull() & F.col("predicted").isNotNull())


def prediction_errors(predictions: DataFrame) -> DataFrame:
    """Adds ``error`` and ``error_pct``, which is NULL where the actual value is 0."""
    error = F.col("predicted") - F.col("actual")
    return (predictions.withColumn("error", error)
            .withColumn("error_pct", F.try_divide(F.col("error"), F.col("actual")) * 100))


def regression_metrics(predictions: DataFrame, keys: Sequence[str] = ("measure",)) -> DataFrame:
    """MAE, RMSE, MAPE (%) and R² in one aggregation; R² is NULL for constant actuals."""
    a, p = F.col("actual"), F.col("predicted")
    both = predictions.filter(a.isNotNull() & p.isNotNull())
    sums = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(F.abs(p - a)).alias("mae"),
        F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"),
        (F.avg(F.abs(F.try_divide(a - p, a + F.lit(RATIO_EPSILON)))) * 100).alias("mape"),
        F.try_divide(F.avg((a - p) * (a - p)), F.var_pop(a)).alias("_unexplained"))
    return sums.withColumn("r2", 1 - F.col("_unexplained")).drop("_unexplained")


def high_periods(predictions: DataFrame, keys: tuple[str, ...] = ("measure",), prob: float = 0.9) -> DataFrame:
    """Predictions strictly above their group's quantile, with the threshold."""
    by = tuple(keys)
    q = quantiles(predictions, ["predicted"], [prob], by, name="_column")
    thresholds = q.select(*by, F.col("q")[0].alias("threshold"))
    return attach(predictions, thresholds, by).filter(F.col("predicted") > F.col("threshold"))


def forecast_stats(forecasts: DataFrame, keys: Sequence[str], ts: str = "datetime", value: str = "forecast") -> DataFrame:
    """Mean, peak and last-minus-first of every forecast series."""
    return forecasts.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.max(value).alias("peak"),
        (F.max_by(value, ts) - F.min_by(value, ts)).alias("trend"))


def diag_range(predictions: DataFrame, keys: Sequence[str] = ("measure",)) -> DataFrame:
    """Ends of the identity line: extremes over actual and predicted together."""
    return predictions.groupBy(*keys).agg(
        F.least(F.min("actual"), F.min("predicted")).alias("low"),
        F.greatest(F.max("actual"), F.max("predicted")).alias("high"))


def naive_forecast(df: DataFrame, s: Series, measures: Sequence[str], hours: int) -> DataFrame:
    """Last value of every series and measure, repeated for ``hours`` steps."""
    last = to_long(latest_reading(df, s), measures, [*s.keys, s.ts])
    ahead = last.filter(F.col("value").isNotNull()).select(
        *s.keys, "measure", F.col(s.ts).alias("_last"), F.col("value").alias("forecast"),
        F.explode(F.sequence(F.lit(1), F.lit(hours))).alias("step"))
    return ahead.select(*s.keys, "measure", "step",
                        from_seconds(seconds("_last") + F.col("step") * HOUR).alias(s.ts), "forecast")


def prediction_insights(predictions: DataFrame, s: Series) -> DataFrame:
    """Rows (keys, measure, kind, value, n): high periods, accuracy flags and trends."""
    by = (*s.keys, "measure")
    high = high_periods(predictions, by).groupBy(*by).agg(
        F.max("threshold").alias("value"), F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("high_period"))
    metrics = regression_metrics(predictions, by).filter((F.col("r2") > 0.95) | (F.col("r2") < 0.80))
    flags = metrics.select(*by, F.col("r2").alias("value"), F.col("samples").alias("n"),
                           F.when(F.col("r2") > 0.95, "accurate").otherwise("inaccurate").alias("kind"))
    trend = half_trend(predictions, s.within("measure"), "predicted").filter(F.col("direction").isNotNull())
    trends = trend.select(*by, F.col("change_pct").alias("value"), F.lit(None).cast("long").alias("n"),
                          F.col("direction").alias("kind"))
    cols = [*by, "kind", "value", "n"]
    return high.select(*cols).unionByName(flags.select(*cols)).unionByName(trends.select(*cols))
