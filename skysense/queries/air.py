"""Air-quality index, categories, advice and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysense.constants import AQI_CATEGORIES, HEALTH_ADVICE, PM25_BREAKPOINTS
from skysense.functions import aqi as fn
from skysense.operators import air, grid, impute
from skysense.queries.common import HOURLY_SQL, HOURS, MS, grid_sql, interp_sql, query, r
from skysense.queries.cleaning import FIRST_SQL
from skysense.session import materialize
from skysense.sources import readings


def aqi_sql(c: str, missing: str = "500") -> str:
    bands = " ".join(
        f"WHEN {c} >= {lo}::DOUBLE AND {c} <= {hi}::DOUBLE THEN round_even(({ahi - alo}.0::DOUBLE / ({hi}::DOUBLE - {lo}::DOUBLE)) * ({c} - {lo}::DOUBLE) + {alo}, 0)::BIGINT"
        for lo, hi, alo, ahi in PM25_BREAKPOINTS)
    return f"CASE WHEN {c} IS NULL THEN {missing} {bands} ELSE 500 END"


def bands_sql(a: str, bands, i: int) -> str:
    return "CASE " + " ".join(f"WHEN {a} <= {b[0]} THEN '{b[i]}'" for b in bands if b[0] is not None) + f" WHEN {a} IS NOT NULL THEN '{bands[-1][i]}' END"


CAT = bands_sql("aqi", AQI_CATEGORIES, 1)
COLOR = bands_sql("aqi", AQI_CATEGORIES, 2)
ADVICE = bands_sql("aqi", HEALTH_ADVICE, 1)
INDEXED = f"indexed AS (SELECT station, datetime, pm2_5, {aqi_sql('pm2_5', 'NULL')} AS aqi FROM hourly)"


@query("aqi_categories", f"""WITH {FIRST_SQL}, {grid_sql('uniq', 'g')}, {interp_sql('g', 'f')}, a AS (SELECT station, {aqi_sql('pm2_5', 'NULL')} AS aqi FROM f)
SELECT station, {CAT} AS category, count(*) AS n FROM a WHERE aqi IS NOT NULL GROUP BY 1, 2""")
def aqi_categories(spark, sf):
    """Flagship: first event per hour, regular grid, interpolation, index, category counts."""
    unique = materialize(grid.dedupe_first(readings.event_rows(spark, sf), HOURS, "event_id"))
    on_grid = materialize(grid.grid_left_join(unique.drop("event_id"), HOURS))
    filled = impute.interpolate(on_grid, HOURS, ["pm2_5"])
    return air.category_distribution(filled, ("station",))


@query("aqi_pm25", f"WITH {HOURLY_SQL} SELECT station, datetime, {r('pm2_5')}, {aqi_sql('pm2_5')} AS aqi FROM hourly")
def aqi_pm25(spark, sf):
    return readings.hourly(spark, sf).select("station", "datetime", "pm2_5", fn.aqi(F.col("pm2_5")).alias("aqi"))


@query("aqi_events", f"SELECT event_id, {aqi_sql('value')} AS aqi FROM events")
def aqi_events(spark, sf):
    """The index of every single event value; values of the events reach all bands and gaps."""
    return readings.table(spark, sf, "events").select("event_id", fn.aqi(F.col("value")).alias("aqi"))


@query("aqi_category", f"WITH {HOURLY_SQL}, {INDEXED} SELECT station, datetime, {r('pm2_5')}, aqi, {CAT} AS category, {COLOR} AS color FROM indexed")
def aqi_category(spark, sf):
    return air.with_aqi(readings.hourly(spark, sf).select("station", "datetime", "pm2_5"))


@query("aqi_current", f"""WITH {HOURLY_SQL}, l AS (SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY station ORDER BY datetime DESC) = 1),
a AS (SELECT *, {aqi_sql('pm2_5')} AS aqi FROM l)
SELECT station, datetime, {", ".join(r(m) for m in MS)}, aqi, {CAT} AS category, {COLOR} AS color, {ADVICE} AS advice FROM a""")
def aqi_current(spark, sf):
    return air.aqi_current(readings.hourly(spark, sf), HOURS)


@query("health_advice", f"WITH {HOURLY_SQL}, {INDEXED} SELECT station, {ADVICE} AS advice, count(*) AS n FROM indexed WHERE aqi IS NOT NULL GROUP BY 1, 2")
def health_advice(spark, sf):
    return air.advice_distribution(readings.hourly(spark, sf), ("station",))


@query("aqi_alerts", f"WITH {HOURLY_SQL}, {INDEXED} SELECT station, datetime, {r('pm2_5')}, aqi, {CAT} AS category, {COLOR} AS color FROM indexed WHERE aqi > 100")
def aqi_alerts(spark, sf):
    return air.aqi_alerts(readings.hourly(spark, sf).select("station", "datetime", "pm2_5"))
