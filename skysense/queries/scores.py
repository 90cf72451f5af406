"""Errors, metrics, insights and simple forecasts on a deterministic predictor."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysense.operators import impute, profile, scoring
from skysense.queries.air import CAT, aqi_sql
from skysense.operators import air
from skysense.queries.common import (
    DAILY_SQL, DAYS, DS, FILLED_SQL, HOURS, MS, PREDICTIONS_SQL, daily, hourly, long_sql, query, r, rounded,
)
from skysense.queries.tables import predictions
from skysense.session import materialize

BY = "station, measure"
R2 = "1 - avg((actual - predicted) ** 2) / nullif(var_pop(actual), 0)"
METRICS = f"""count(*) AS samples, {r("avg(abs(predicted - actual))", "mae")}, {r("sqrt(avg((predicted - actual) ** 2))", "rmse")},
  {r("avg(abs((actual - predicted) / nullif(actual + 1e-6, 0))) * 100", "mape")}, {r(R2, "r2")}"""


@query("regression_metrics", f"WITH {PREDICTIONS_SQL} SELECT {BY}, {METRICS} FROM predictions GROUP BY {BY}")
def regression_metrics(spark, sf):
    return scoring.regression_metrics(predictions(spark, sf), ("station", "measure"))


@query("prediction_errors", f"""WITH {PREDICTIONS_SQL} SELECT station, datetime, measure, {rounded(["actual", "predicted"])}, {r("predicted - actual", "error")},
  {r("(predicted - actual) / nullif(actual, 0) * 100", "error_pct")} FROM predictions""")
def prediction_errors(spark, sf):
    return scoring.prediction_errors(predictions(spark, sf))


@query("error_histogram", f"""WITH {PREDICTIONS_SQL}, e AS (SELECT measure, predicted - actual AS error FROM predictions),
lim AS (SELECT min(error) AS lo, max(error) AS hi FROM e)
SELECT 'error' AS measure, least(floor((error - lo) / (hi - lo) * 50) + 1, 50)::BIGINT AS bin, {r("min(lo) + (min(hi) - min(lo)) / 50 * (bin - 1)", "bin_start")},
  {r("min(lo) + (min(hi) - min(lo)) / 50 * bin", "bin_end")}, count(*) AS n FROM e, lim GROUP BY bin""")
def error_histogram(spark, sf):
    errors = materialize(scoring.prediction_errors(predictions(spark, sf)).select("error"))
    return profile.histogram(errors, ["error"])


THRESHOLDS = f"th AS (SELECT {BY}, quantile_cont(predicted, 0.9) AS threshold FROM predictions GROUP BY {BY})"


@query("high_periods", f"""WITH {PREDICTIONS_SQL}, {THRESHOLDS} SELECT station, measure, datetime, {rounded(["actual", "predicted", "threshold"])}
FROM predictions JOIN th USING (station, measure) WHERE predicted > threshold""")
def high_periods(spark, sf):
    return scoring.high_periods(materialize(predictions(spark, sf)), ("station", "measure"))


@query("forecast_stats", f"""WITH {FILLED_SQL}, {long_sql('filled')}
SELECT station, measure, {r("avg(value)", "mean")}, {r("max(value)", "peak")}, {r("arg_max(value, datetime) - arg_min(value, datetime)", "trend")} FROM long GROUP BY 1, 2""")
def forecast_stats(spark, sf):
    """Over the filled readings taken as a forecast, so that the numbers have a reference."""
    from skysense.operators.shapes import to_long

    filled = impute.interpolate(hourly(spark, sf), HOURS, MS)
    as_forecast = to_long(filled, MS, ["station", "datetime"], value="forecast")
    return scoring.forecast_stats(as_forecast, ("station", "measure"))


@query("prediction_insights", f"""WITH {PREDICTIONS_SQL}, {THRESHOLDS},
hp AS (SELECT {BY}, 'high_period' AS kind, max(threshold) AS value, count(*) AS n FROM predictions JOIN th USING (station, measure) WHERE predicted > threshold GROUP BY {BY}),
m AS (SELECT {BY}, {R2} AS r2, count(*) AS n FROM predictions GROUP BY {BY}),
p AS (SELECT *, row_number() OVER (PARTITION BY {BY} ORDER BY datetime) - 1 AS pos, count(*) OVER (PARTITION BY {BY}) AS total FROM predictions),
h AS (SELECT {BY}, avg(predicted) FILTER (WHERE pos < total // 2) AS a, avg(predicted) FILTER (WHERE pos >= total // 2) AS b FROM p GROUP BY {BY}),
t AS (SELECT {BY}, (b - a) / nullif(a, 0) * 100 AS change FROM h)
SELECT {BY}, kind, {r("value")}, n FROM hp
UNION ALL SELECT {BY}, CASE WHEN r2 > 0.95 THEN 'accurate' ELSE 'inaccurate' END, {r("r2")}, n FROM m WHERE r2 > 0.95 OR r2 < 0.80
UNION ALL SELECT {BY}, CASE WHEN change > 20 THEN 'increasing' ELSE 'decreasing' END, {r("change")}, NULL FROM t WHERE abs(change) > 20""")
def prediction_insights(spark, sf):
    return scoring.prediction_insights(materialize(predictions(spark, sf)), HOURS)


@query("naive_forecast", f"""WITH {DAILY_SQL}, {long_sql('daily', DS)}, l AS (SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY {BY} ORDER BY datetime DESC) = 1)
SELECT {BY}, i::BIGINT AS step, datetime + to_hours(i) AS datetime, {r("value", "forecast")} FROM l, range(1, 25) t(i) WHERE value IS NOT NULL""")
def naive_forecast(spark, sf):
    return scoring.naive_forecast(daily(spark, sf), DAYS, DS, 24)


@query("diag_range", f"""WITH {PREDICTIONS_SQL} SELECT measure, {r("least(min(actual), min(predicted))", "low")}, {r("greatest(max(actual), max(predicted))", "high")}
FROM predictions GROUP BY 1""")
def diag_range(spark, sf):
    return scoring.diag_range(predictions(spark, sf))


@query("aqi_from_baseline", f"""WITH {PREDICTIONS_SQL}, a AS (SELECT station, datetime, predicted, {aqi_sql("predicted")} AS aqi FROM predictions WHERE measure = 'pm2_5')
SELECT station, datetime, {r("predicted")}, aqi, {CAT} AS category FROM a""")
def aqi_from_baseline(spark, sf):
    made = predictions(spark, sf).filter(F.col("measure") == "pm2_5").select("station", "datetime", "predicted")
    return air.with_aqi(made, "predicted", mode="strict").drop("color")
