"""Imputation, outliers, duplicates, grids, scaling, split, and the cleaning plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysense.operators import grid, impute, outliers, scaling
from skysense.plans import cleaning as plans
from skysense.queries.common import (
    DAILY_SQL, DAYS, DS, HOURLY_SQL, HOURS, MS, cap_sql, daily, each, grid_sql, hourly, interp_sql, long_sql, query, r, rounded,
)
from skysense.queries.tables import ALL
from skysense.series import Series
from skysense.session import materialize
from skysense.sources import readings

NOT_NULL = each("{m} IS NOT NULL", MS, " AND ")


@query("interp_time", f"WITH {HOURLY_SQL}, {interp_sql('hourly', 'f')} SELECT {ALL} FROM f")
def interp_time(spark, sf):
    return impute.interpolate(hourly(spark, sf), HOURS, MS)


@query("interp_time_one_series", f"""WITH one AS (SELECT 0 AS station, date_trunc('hour', ts) AS datetime,
  {each("round(avg(value) FILTER (WHERE event_type = '{m}'), 6) AS v_{m}", ("click", "error"))} FROM events GROUP BY 2),
{interp_sql('one', 'f', measures=("v_click", "v_error"))} SELECT datetime, {r("v_click")}, {r("v_error")} FROM f""")
def interp_time_one_series(spark, sf):
    """All events as one series without keys; only the chunks spread the work."""
    e = readings.table(spark, sf, "events")
    one = e.groupBy(F.window("ts", "1 hour")["start"].alias("datetime")).agg(
        *[F.round(F.avg(F.when(F.col("event_type") == t, F.col("value"))), 6).alias(f"v_{t}") for t in ("click", "error")])
    return impute.interpolate(materialize(one), Series(keys=()), ["v_click", "v_error"])


@query("ffill", f"""WITH {HOURLY_SQL}, f AS (SELECT station, datetime,
  {each("last_value({m} IGNORE NULLS) OVER (PARTITION BY station ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {m}")}
  FROM hourly) SELECT {ALL} FROM f WHERE {NOT_NULL}""")
def ffill(spark, sf):
    return impute.fill_missing(hourly(spark, sf), HOURS, MS, "forward_fill")


@query("interp_linear", f"WITH {HOURLY_SQL}, {interp_sql('hourly', 'f', by='row')} SELECT {ALL} FROM f")
def interp_linear(spark, sf):
    return impute.interpolate(hourly(spark, sf), HOURS, MS, by="row")


def smart_sql(src: str, out: str, part: str = "station") -> str:
    sparse = each("(count(*) FILTER (WHERE {m} IS NULL)) * 2 > count(*) AS sp_{m}, median({m}) AS md_{m}")
    value = each("CASE WHEN sp_{m} THEN coalesce(s.{m}, md_{m}) ELSE f.{m} END AS {m}")
    return (f"{interp_sql(src, out + '_f', by='row')}, {out}_p AS (SELECT {part}, {sparse} FROM {src} GROUP BY {part}), "
            f"{out} AS (SELECT s.station, s.datetime, {value} FROM {src} s JOIN {out}_p p USING ({part}) "
            f"JOIN {out}_f f ON f.station = s.station AND f.datetime = s.datetime)")


@query("impute_smart", f"WITH {HOURLY_SQL}, {smart_sql('hourly', 'f')} SELECT {ALL} FROM f")
def impute_smart(spark, sf):
    return impute.impute_smart(hourly(spark, sf), HOURS, MS)


@query("cap_iqr", f"WITH {HOURLY_SQL}, {cap_sql('hourly', 'c')} SELECT {ALL} FROM c")
def cap_iqr(spark, sf):
    return outliers.cap_outliers(hourly(spark, sf), MS, ("station",))


@query("cap_iqr_daily", f"WITH {DAILY_SQL}, {cap_sql('daily', 'c', DS, 1.0)} SELECT station, datetime, {rounded(DS)} FROM c")
def cap_iqr_daily(spark, sf):
    return outliers.cap_outliers(daily(spark, sf), DS, ("station",), k=1.0)


@query("cap_zscore", f"""WITH {HOURLY_SQL}, z AS (SELECT station,
  {each("avg({m}) - 3 * stddev_samp({m}) AS a_{m}, avg({m}) + 3 * stddev_samp({m}) AS b_{m}")} FROM hourly GROUP BY 1)
SELECT station, datetime, {each(r("CASE WHEN {m} < a_{m} THEN a_{m} WHEN {m} > b_{m} THEN b_{m} ELSE {m} END", "{m}"))}
FROM hourly JOIN z USING (station)""")
def cap_zscore(spark, sf):
    return outliers.cap_outliers(hourly(spark, sf), MS, ("station",), method="zscore")


@query("count_outliers", f"""WITH {HOURLY_SQL}, {long_sql()},
q AS (SELECT station, measure, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM long GROUP BY 1, 2)
SELECT k::DOUBLE AS k, station, measure, count(*) FILTER (WHERE value < a - k * (b - a) OR value > b + k * (b - a)) AS outliers,
  {r("count(*) FILTER (WHERE value < a - k * (b - a) OR value > b + k * (b - a)) * 100.0::DOUBLE / count(*)", "outlier_pct")}
FROM long JOIN q USING (station, measure), (VALUES (3.0::DOUBLE), (1.5::DOUBLE)) t(k) GROUP BY k, station, measure""")
def count_outliers(spark, sf):
    h = hourly(spark, sf)
    three, less = (outliers.count_outliers(h, MS, ("station",), k=k).withColumn("k", F.lit(k)) for k in (3.0, 1.5))
    return three.unionByName(less)


@query("floor_positive", f"""WITH {HOURLY_SQL} SELECT station, datetime,
  {each(r("CASE WHEN {m} < 0.1 THEN 0.1 ELSE {m} END", "{m}"))} FROM hourly""")
def floor_positive(spark, sf):
    return outliers.floor_positive(readings.hourly(spark, sf), MS)


FIRST_SQL = f"""event_rows AS (SELECT user_id % 4 AS station, date_trunc('hour', ts) AS datetime, event_id,
  {", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS {m}" for t, m in readings.EVENT_MEASURES.items())} FROM events),
uniq AS (SELECT * FROM event_rows QUALIFY row_number() OVER (PARTITION BY station, datetime ORDER BY event_id) = 1)"""


@query("dedupe_first", f"WITH {FIRST_SQL} SELECT station, datetime, event_id, {rounded(MS)} FROM uniq")
def dedupe_first(spark, sf):
    return grid.dedupe_first(readings.event_rows(spark, sf), HOURS, "event_id")


@query("regularize", f"""WITH {HOURLY_SQL}, {grid_sql('hourly', 'g')}, {interp_sql('g', 'f', leading=False)} SELECT {ALL} FROM f""")
def regularize(spark, sf):
    return grid.regularize(hourly(spark, sf), HOURS, MS)


@query("cadence_profile", f"""WITH {DAILY_SQL}, d AS (SELECT station,
  epoch(datetime)::BIGINT - epoch(lag(datetime) OVER (PARTITION BY station ORDER BY datetime))::BIGINT AS gap FROM daily)
SELECT station, count(gap) AS intervals, min(gap) AS min_seconds, max(gap) AS max_seconds, {r("median(gap)", "median_seconds")}
FROM d GROUP BY 1""")
def cadence_profile(spark, sf):
    return grid.cadence_profile(daily(spark, sf), DAYS)


BINS_SQL = f"""bins AS (SELECT station, time_bucket(INTERVAL 6 HOUR, datetime, TIMESTAMP '1970-01-01') AS datetime,
  {each("avg({m}) AS {m}")} FROM hourly GROUP BY 1, 2)"""


@query("resample_mean", f"WITH {HOURLY_SQL}, {BINS_SQL}, {grid_sql('bins', 'g', 'INTERVAL 6 HOUR')} SELECT {ALL} FROM g")
def resample_mean(spark, sf):
    return grid.resample_mean(hourly(spark, sf), HOURS, MS, 6 * grid.HOUR)


def scaled_sql(shift: str, width: str) -> str:
    return f"""p AS (SELECT station, {each(f"{shift} AS s_{{m}}, {width} AS w_{{m}}")} FROM hourly GROUP BY 1),
scaled AS (SELECT station, datetime, {each("({m} - s_{m}) / nullif(w_{m}, 0) AS {m}")} FROM hourly JOIN p USING (station))"""


@query("normalize_minmax", f"WITH {HOURLY_SQL}, {scaled_sql('min({m})', 'max({m}) - min({m})')} SELECT {ALL} FROM scaled")
def normalize_minmax(spark, sf):
    h = hourly(spark, sf)
    return scaling.normalize(h, scaling.scaler_params(h, MS, ("station",)), MS, ("station",))


@query("normalize_standard", f"WITH {HOURLY_SQL}, {scaled_sql('avg({m})', 'stddev_samp({m})')} SELECT {ALL} FROM scaled")
def normalize_standard(spark, sf):
    h = hourly(spark, sf)
    return scaling.normalize(h, scaling.scaler_params(h, MS, ("station",), method="standard"), MS, ("station",))


@query("inverse_normalize", f"WITH {HOURLY_SQL} SELECT {ALL} FROM hourly")
def inverse_normalize(spark, sf):
    h = hourly(spark, sf)
    params = materialize(scaling.scaler_params(h, MS, ("station",), method="standard"))
    return scaling.inverse_normalize(scaling.normalize(h, params, MS, ("station",)), params, MS, ("station",))


def split_sql(src: str, out: str) -> str:
    return f"""{out} AS (SELECT *, CASE WHEN pos < floor(n * (1 - 0.2::DOUBLE - 0.1::DOUBLE)) THEN 'train'
  WHEN pos < floor(n * (1 - 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM (SELECT *,
  row_number() OVER (PARTITION BY station ORDER BY datetime) - 1 AS pos, count(*) OVER (PARTITION BY station) AS n FROM {src}))"""


@query("split_time", f"WITH {DAILY_SQL}, {split_sql('daily', 's')} SELECT station, datetime, split FROM s")
def split_time(spark, sf):
    return scaling.split_time(daily(spark, sf).select("station", "datetime"), DAYS)


TRAIN_SCALE_SQL = f"""p AS (SELECT station, {each("min({m}) AS s_{m}, max({m}) - min({m}) AS w_{m}")}
  FROM parts WHERE split = 'train' GROUP BY 1),
scaled AS (SELECT station, datetime, split, {each("({m} - s_{m}) / nullif(w_{m}, 0) AS {m}")} FROM parts LEFT JOIN p USING (station))"""


@query("param_broadcast", f"WITH {HOURLY_SQL}, {split_sql('hourly', 'parts')}, {TRAIN_SCALE_SQL} SELECT {ALL}, split FROM scaled WHERE split <> 'train'")
def param_broadcast(spark, sf):
    parts = materialize(scaling.split_time(hourly(spark, sf), HOURS))
    params = scaling.scaler_params(parts.filter(F.col("split") == "train"), MS, ("station",))
    return scaling.normalize(parts.filter(F.col("split") != "train"), params, MS, ("station",))


def messy(spark, sf):
    """Event rows under foreign column names, with text times and several rows per hour."""
    e = readings.event_rows(spark, sf)
    stamp = F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.date_format("datetime", "dd/MM/yyyy HH:mm"))
    return e.select(stamp.alias("Date Time"), "station", "event_id", F.col("pm2_5").alias("PM 2.5"),
                    F.col("pm10").alias("PM_10"), F.col("no2").alias("NO2"), F.col("so2").alias("so.2"),
                    F.col("co").alias("Carbon Monoxide"), F.lit("x").alias("note"))


MESSY_SQL = f"""event_rows AS (SELECT user_id % 4 AS station, date_trunc('hour', ts) AS datetime, event_id,
  {", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS {m}" for t, m in readings.EVENT_MEASURES.items())}
  FROM events WHERE event_id % 10 <> 0),
uniq AS (SELECT * EXCLUDE (event_id) FROM event_rows QUALIFY row_number() OVER (PARTITION BY station, datetime ORDER BY event_id) = 1),
{smart_sql('uniq', 'filled')}, {cap_sql('filled', 'capped')}, {grid_sql('capped', 'g')}, {interp_sql('g', 'cleaned', leading=False)}"""


@query("clean_pipeline", f"WITH {MESSY_SQL} SELECT {ALL} FROM cleaned")
def clean_pipeline(spark, sf):
    return plans.clean(messy(spark, sf), HOURS, "event_id").data


CLEAN_LOG_CTES = f"fences AS (SELECT * FROM capped_q), {long_sql('filled')}, {long_sql('cleaned', name='done')}"
CLEAN_LOG_SELECT = f"""SELECT 1 AS step, 'parse_datetime' AS action, 'rows with a valid time' AS detail, count(*) AS n FROM event_rows
UNION ALL SELECT 2, 'dedupe', 'rows after duplicate removal', count(*) FROM uniq
UNION ALL SELECT 3, 'impute_before', 'missing values', {each("count(*) FILTER (WHERE {m} IS NULL)", MS, " + ")} FROM uniq
UNION ALL SELECT 4, 'impute_after', 'missing values', {each("count(*) FILTER (WHERE {m} IS NULL)", MS, " + ")} FROM filled
{each("UNION ALL SELECT 5, 'cap_outliers', '{m}', count(*) FILTER (WHERE f.{m} < a_{m} - 3.0 * (b_{m} - a_{m}) OR f.{m} > b_{m} + 3.0 * (b_{m} - a_{m})) FROM filled f JOIN fences USING (station)", MS, " ")}
UNION ALL SELECT 6, 'regularize', 'rows on the regular grid', count(*) FROM cleaned
UNION ALL SELECT 7, 'range_check', measure, count(*) FILTER (WHERE value < low OR value > high) FROM done JOIN
 (VALUES ('pm2_5', 0, 500), ('pm10', 0, 1000), ('no2', 0, 500), ('so2', 0, 500), ('co', 0, 50)) t(measure, low, high) USING (measure) GROUP BY measure"""


@query("clean_log", f"WITH {MESSY_SQL}, {CLEAN_LOG_CTES} {CLEAN_LOG_SELECT}")
def clean_log(spark, sf):
    return plans.clean(messy(spark, sf), HOURS, "event_id").log


@query("upload_pipeline", f"WITH {HOURLY_SQL}, {interp_sql('hourly', 'f', by='row')}, {cap_sql('f', 'c')} SELECT {ALL} FROM c")
def upload_pipeline(spark, sf):
    h = readings.hourly(spark, sf)
    upload = h.select(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), "station", *MS, F.lit(1).alias("note"))
    return plans.prepare_upload(upload, HOURS)


@query("upload_without_times", f"""WITH {HOURLY_SQL}, numbered AS (SELECT * REPLACE (
  TIMESTAMP '2024-01-01' + to_hours(row_number() OVER (PARTITION BY station ORDER BY datetime) - 1) AS datetime) FROM hourly),
{interp_sql('numbered', 'f', by='row')}, {cap_sql('f', 'c')} SELECT {ALL} FROM c""")
def upload_without_times(spark, sf):
    """Times that can't be read: all rows stay and get an hourly axis in their order."""
    h = hourly(spark, sf)
    upload = h.select(F.concat(F.lit("about "), F.col("datetime").cast("string")).alias("Date"), "station", *MS,
                      F.unix_timestamp(F.col("datetime").cast("timestamp")).alias("row"), F.lit("w").alias("width"))
    return plans.prepare_upload(upload, HOURS, seq="row", start="2024-01-01 00:00:00")


MEDIAN_SQL = f"""med AS (SELECT station, {each("median({m}) AS q_{m}")} FROM uniq GROUP BY 1),
filled AS (SELECT station, datetime, {each("coalesce({m}, q_{m}) AS {m}")} FROM uniq JOIN med USING (station)),
whole AS (SELECT * FROM filled WHERE {NOT_NULL})"""


@query("clean_median", f"""WITH {FIRST_SQL}, {MEDIAN_SQL}, {cap_sql('whole', 'capped')}, {grid_sql('capped', 'g')},
{interp_sql('g', 'cleaned', leading=False)} SELECT {ALL} FROM cleaned""")
def clean_median(spark, sf):
    return plans.clean(readings.event_rows(spark, sf), HOURS, "event_id", missing="median").data


@query("clean_daily_zscore", f"""WITH {FIRST_SQL}, {smart_sql('uniq', 'filled')}, z AS (SELECT station,
  {each("avg({m}) - 3 * stddev_samp({m}) AS a_{m}, avg({m}) + 3 * stddev_samp({m}) AS b_{m}")} FROM filled GROUP BY 1),
capped AS (SELECT station, datetime, {each("CASE WHEN {m} < a_{m} THEN a_{m} WHEN {m} > b_{m} THEN b_{m} ELSE {m} END AS {m}")}
  FROM filled JOIN z USING (station)), {grid_sql('capped', 'g', 'INTERVAL 1 DAY')}, {interp_sql('g', 'cleaned', leading=False)}
SELECT {ALL} FROM cleaned""")
def clean_daily_zscore(spark, sf):
    return plans.clean(readings.event_rows(spark, sf), HOURS, "event_id", outlier="zscore", step=grid.DAY).data


TRAIN_SQL = f"""{HOURLY_SQL}, {interp_sql('hourly', 'f')}, nn AS (SELECT * FROM f WHERE {NOT_NULL}),
{cap_sql('nn', 'c')}, {split_sql('c', 'parts')}"""


@query("train_prep_pipeline", f"WITH {TRAIN_SQL}, {TRAIN_SCALE_SQL} SELECT {ALL}, split FROM scaled")
def train_prep_pipeline(spark, sf):
    return plans.prepare_training(hourly(spark, sf), HOURS, MS).data


RESAMPLED_SQL = f"""{HOURLY_SQL}, {interp_sql('hourly', 'f')}, nn AS (SELECT * FROM f WHERE {NOT_NULL}), {cap_sql('nn', 'c')},
bins AS (SELECT station, time_bucket(INTERVAL 6 HOUR, datetime, TIMESTAMP '1970-01-01') AS datetime, {each("avg({m}) AS {m}")} FROM c GROUP BY 1, 2),
{grid_sql('bins', 'g', 'INTERVAL 6 HOUR')}, {split_sql('g', 'parts')},
p AS (SELECT station, {each("avg({m}) AS s_{m}, stddev_samp({m}) AS w_{m}")} FROM parts WHERE split = 'train' GROUP BY 1),
scaled AS (SELECT station, datetime, split, {each("({m} - s_{m}) / nullif(w_{m}, 0) AS {m}")} FROM parts LEFT JOIN p USING (station))"""


@query("train_prep_resampled", f"WITH {RESAMPLED_SQL} SELECT {ALL}, split FROM scaled")
def train_prep_resampled(spark, sf):
    """Six-hour means and standard scaling."""
    return plans.prepare_training(hourly(spark, sf), HOURS, MS, step=6 * grid.HOUR, scale="standard").data
