"""Lag, rolling, calendar, interaction and sequence features."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysense.functions import calendar
from skysense.operators import features, impute
from skysense.constants import LAGS, ROLLING_WINDOWS
from skysense.queries.common import (
    DAILY_SQL, DAYS, DS, FILLED_SQL, HOURLY_SQL, HOURS, MS, PREDICTIONS_SQL, daily, each, hourly, query, r, rounded,
)
from skysense.queries.tables import ALL, predictions
from skysense.session import materialize
from skysense.sources import readings


def filled(spark, sf):
    return materialize(impute.interpolate(hourly(spark, sf), HOURS, MS))


def lags_sql(m: str, lags=LAGS, part: str = "station") -> str:
    return ", ".join(f"lag({m}, {k}) OVER (PARTITION BY {part} ORDER BY datetime) AS {m}_lag_{k}" for k in lags)


def rolling_sql(m: str, windows=ROLLING_WINDOWS, stats=("mean", "std", "min", "max"), part: str = "station", shift: int = 0) -> str:
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    out = []
    for w in windows:
        end = "CURRENT ROW" if not shift else "1 PRECEDING"
        over = f"(PARTITION BY {part} ORDER BY datetime ROWS BETWEEN {w - 1 + shift} PRECEDING AND {end})"
        out += [f"CASE WHEN count({m}) OVER {over} = {w} THEN {fn[s]}({m}) OVER {over} END AS {m}_rolling_{s}_{w}" for s in stats]
    return ", ".join(out)


def lag_names(m: str, lags=LAGS) -> list[str]:
    return [f"{m}_lag_{k}" for k in lags]


def rolling_names(m: str, windows=ROLLING_WINDOWS, stats=("mean", "std", "min", "max")) -> list[str]:
    return [f"{m}_rolling_{s}_{w}" for w in windows for s in stats]


TIME_SQL = """hour(datetime)::BIGINT AS hour, sin(2 * pi() * hour(datetime) / 24) AS hour_sin, cos(2 * pi() * hour(datetime) / 24) AS hour_cos,
  isodow(datetime)::BIGINT - 1 AS day_of_week, (isodow(datetime) >= 6)::BIGINT AS is_weekend,
  sin(2 * pi() * (isodow(datetime) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(datetime) - 1) / 7) AS dow_cos,
  month(datetime)::BIGINT AS month, sin(2 * pi() * month(datetime) / 12) AS month_sin, cos(2 * pi() * month(datetime) / 12) AS month_cos,
  ((month(datetime) % 12 + 3) // 3)::BIGINT AS season"""
TIME_INT = ("hour", "day_of_week", "is_weekend", "month", "season")
TIME_DOUBLE = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos")
TIME_OUT = ", ".join(TIME_INT) + ", " + rounded(TIME_DOUBLE)


@query("lag_features", f"""WITH {DAILY_SQL}, l AS (SELECT *, {lags_sql('price')} FROM daily)
SELECT station, datetime, {rounded(DS)}, {rounded(lag_names('price'))} FROM l""")
def lag_features(spark, sf):
    return features.lag_features(daily(spark, sf), DAYS, ["price"])


@query("rolling_features", f"""WITH {DAILY_SQL}, l AS (SELECT *, {rolling_sql('price')} FROM daily)
SELECT station, datetime, {rounded(DS)}, {rounded(rolling_names('price'))} FROM l""")
def rolling_features(spark, sf):
    return features.rolling_features(daily(spark, sf), DAYS, ["price"])


@query("rolling_with_gaps", f"""WITH {HOURLY_SQL}, l AS (SELECT *, {rolling_sql('pm2_5', (3, 6))} FROM hourly)
SELECT {ALL}, {rounded(rolling_names('pm2_5', (3, 6)))} FROM l""")
def rolling_with_gaps(spark, sf):
    return features.rolling_features(hourly(spark, sf), HOURS, ["pm2_5"], (3, 6))


@query("time_features", f"WITH {DAILY_SQL}, t AS (SELECT *, {TIME_SQL} FROM daily) SELECT station, datetime, {rounded(DS)}, {TIME_OUT} FROM t")
def time_features(spark, sf):
    return features.time_features(readings.daily(spark, sf))


@query("cyclic_features", f"WITH {HOURLY_SQL}, t AS (SELECT *, {TIME_SQL} FROM hourly) SELECT station, datetime, {rounded(TIME_DOUBLE)} FROM t")
def cyclic_features(spark, sf):
    h = readings.hourly(spark, sf).select("station", "datetime")
    return features.time_features(h).select("station", "datetime", *TIME_DOUBLE)


INTERACTIONS_SQL = "pm2_5 / nullif(pm10 + 1e-6, 0) AS \"PM_ratio\""


@query("interaction_features", f"""WITH {HOURLY_SQL}, t AS (SELECT *, co AS o3, {INTERACTIONS_SQL} FROM hourly)
SELECT {ALL}, {r("o3")}, {r('"PM_ratio"')}, {r("no2 * o3", '"NO2_O3_interaction"')} FROM t""")
def interaction_features(spark, sf):
    # The events have no ozone; another measure stands in so that both products are made.
    return features.interaction_features(readings.hourly(spark, sf).withColumn("o3", F.col("co")))


@query("all_features", f"""WITH {FILLED_SQL}, t AS (SELECT station, datetime, {each('{m}')}, {TIME_SQL}, {lags_sql('pm2_5')}, {rolling_sql('pm2_5')},
  {INTERACTIONS_SQL} FROM filled)
SELECT {ALL}, {TIME_OUT}, {rounded(lag_names('pm2_5'))}, {rounded(rolling_names('pm2_5'))}, {r('"PM_ratio"')} FROM t
WHERE pm2_5_lag_24 IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in rolling_names('pm2_5'))}""")
def all_features(spark, sf):
    return features.all_features(filled(spark, sf), HOURS, "pm2_5")


SUP_LAGS = lag_names("pm2_5", range(1, 25))
SUP_ROLL = rolling_names("pm2_5", stats=("mean", "std"))


@query("supervised_features", f"""WITH {FILLED_SQL}, t AS (SELECT station, datetime, {each('{m}')}, {TIME_SQL}, {lags_sql('pm2_5', range(1, 25))},
  {rolling_sql('pm2_5', stats=('mean', 'std'))} FROM filled)
SELECT {ALL}, {TIME_OUT}, {rounded(SUP_LAGS)}, {rounded(SUP_ROLL)} FROM t WHERE {" AND ".join(f"{c} IS NOT NULL" for c in SUP_LAGS + SUP_ROLL)}""")
def supervised_features(spark, sf):
    return features.supervised_features(filled(spark, sf), HOURS, "pm2_5")


@query("supervised_features_leak_free", f"""WITH {FILLED_SQL}, t AS (SELECT station, datetime, pm2_5,
  {each("lag({m}) OVER (PARTITION BY station ORDER BY datetime) AS {m}", MS[1:])}, {TIME_SQL}, {lags_sql('pm2_5', range(1, 25))},
  {rolling_sql('pm2_5', stats=('mean', 'std'), shift=1)} FROM filled)
SELECT {ALL}, {TIME_OUT}, {rounded(SUP_LAGS)}, {rounded(SUP_ROLL)} FROM t WHERE {" AND ".join(f"{c} IS NOT NULL" for c in SUP_LAGS + SUP_ROLL)}""")
def supervised_features_leak_free(spark, sf):
    return features.supervised_features(filled(spark, sf), HOURS, "pm2_5", leak_free=True)


@query("sequence_windows", f"""WITH {DAILY_SQL}, t AS (SELECT station, datetime,
  list([quantity, price]) OVER (PARTITION BY station ORDER BY datetime ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS x,
  lead(price, 1) OVER (PARTITION BY station ORDER BY datetime) AS y,
  row_number() OVER (PARTITION BY station ORDER BY datetime) AS rn, count(*) OVER (PARTITION BY station) AS n FROM daily)
SELECT station, datetime, len(x) AS steps, {r("x[1][1]", "first_quantity")}, {r("x[6][2]", "last_price")},
  {r("list_sum([v[2] for v in x])", "price_sum")}, {r("y")} FROM t WHERE rn > 6 AND rn + 1 <= n""")
def sequence_windows(spark, sf):
    seq = features.sequence_windows(daily(spark, sf), DAYS, "price", ["quantity", "price"], lookback=6, horizon=2)
    total = F.aggregate("X", F.lit(0.0), lambda a, v: a + v[1])
    return seq.select("station", "datetime", F.size("X").alias("steps"), F.col("X")[0][0].alias("first_quantity"),
                      F.col("X")[5][1].alias("last_price"), total.alias("price_sum"), "y")


@query("calendar_names", f"WITH {DAILY_SQL} SELECT station, datetime, dayname(datetime) AS weekday, monthname(datetime) AS month FROM daily")
def calendar_names(spark, sf):
    return readings.daily(spark, sf).select("station", "datetime", calendar.weekday_name("datetime").alias("weekday"),
                                            calendar.month_name("datetime").alias("month"))


@query("half_trend", f"""WITH {PREDICTIONS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY station, measure ORDER BY datetime) - 1 AS pos,
  count(*) OVER (PARTITION BY station, measure) AS n FROM predictions),
h AS (SELECT station, measure, avg(predicted) FILTER (WHERE pos < n // 2) AS a, avg(predicted) FILTER (WHERE pos >= n // 2) AS b FROM p GROUP BY 1, 2)
SELECT station, measure, {r("a", "first_half")}, {r("b", "second_half")}, {r("(b - a) / nullif(a, 0) * 100", "change_pct")},
  CASE WHEN (b - a) / a * 100 > 20 THEN 'increasing' WHEN (b - a) / a * 100 < -20 THEN 'decreasing' END AS direction FROM h""")
def half_trend(spark, sf):
    return features.half_trend(predictions(spark, sf), HOURS.within("measure"), "predicted")
