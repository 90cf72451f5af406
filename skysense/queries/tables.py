"""Scans, sinks, schema checks, projections, joins, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysense.operators import grid, relational as rel, schema, scoring
from skysense.operators.impute import interpolate
from skysense.operators.outliers import range_validate
from skysense.operators.shapes import to_long
from skysense.queries.common import (
    DAILY_SQL, DAYS, DS, FILLED_SQL, HOURLY_SQL, HOURS, MS, PREDICTIONS_SQL, each, grid_sql, hourly,
    long_sql, query, r, rounded, rr,
)
from skysense.series import Series
from skysense.session import materialize, new_path
from skysense.sources import readings, sinks

ALL = f"station, datetime, {rounded(MS)}"


@query("scan_readings", f"WITH {HOURLY_SQL} SELECT {ALL} FROM hourly")
def scan_readings(spark, sf):
    source = readings.hourly(spark, sf)
    path = sinks.export_csv(source, new_path(spark, "readings-csv"))
    labelled = sinks.with_labels(source).schema
    return sinks.from_labels(readings.scan_readings(spark, path, fmt="csv", schema=labelled))


BAD_CELL, BAD_LINE = "n/a", "7"


def spoilt(spark, sf):
    """The hourly readings as CSV lines: at five o'clock pm10 can't be read, at seven a line has a cell too many."""
    hours = readings.hourly(spark, sf)
    hour = F.hour("datetime")
    cells = [F.col("station").cast("string"), F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"),
             *[F.when(hour == 5, F.lit(BAD_CELL)).otherwise(F.coalesce(F.col(m).cast("string"), F.lit(""))) if m == "pm10"
               else F.coalesce(F.col(m).cast("string"), F.lit("")) for m in MS]]
    line = F.concat(F.concat_ws(",", *cells), F.when(hour == 7, F.lit(f",{BAD_LINE}")).otherwise(F.lit("")))
    path = new_path(spark, "spoilt-csv")
    hours.select(line).write.text(path)
    return readings.scan_checked(spark, path, "station long, datetime timestamp_ntz, " + ", ".join(f"{m} double" for m in MS), header=False)


@query("scan_checked", f"""WITH {HOURLY_SQL} SELECT station, datetime, {rounded(["pm2_5"])},
  CASE WHEN hour(datetime) = 5 THEN NULL ELSE {rr("pm10")} END AS pm10, {rounded(["no2", "so2", "co"])},
  CASE WHEN hour(datetime) = 5 THEN 'cell pm10 n/a' WHEN hour(datetime) = 7 THEN 'line' ELSE '' END AS problems FROM hourly""")
def scan_checked(spark, sf):
    """Rows of a file with bad cells and lines: none is lost, and each says what couldn't be read."""
    rows = spoilt(spark, sf).rows
    said = F.transform("problems", lambda p: F.when(p["reason"] == "line", F.lit("line")).otherwise(
        F.concat_ws(" ", p["reason"], p["column"], p["found"])))
    return rows.withColumn("problems", F.array_join(said, "; "))


@query("validate_upload_checked", f"""WITH {HOURLY_SQL}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE hour(datetime) = 5) AS cells,
  count(*) FILTER (WHERE hour(datetime) = 7) AS lines FROM hourly)
SELECT 'not_empty' AS rule, n > 0 AS ok, n::VARCHAR AS detail FROM n
UNION ALL SELECT 'min_rows', n >= 50, n::VARCHAR FROM n
UNION ALL SELECT 'has_datetime', true, 'datetime' FROM n
UNION ALL SELECT 'has_measure', true, 'pm2_5,pm10,no2,so2,co' FROM n
{each("UNION ALL SELECT 'numeric_{m}', true, 'double' FROM n", MS, " ")}
UNION ALL SELECT 'readable_lines', lines = 0, lines::VARCHAR FROM n
UNION ALL SELECT 'readable_pm10', cells = 0, cells::VARCHAR FROM n
{each("UNION ALL SELECT 'readable_{m}', true, '0' FROM n", ("station", "datetime", "pm2_5", "no2", "so2", "co"), " ")}""")
def validate_upload_checked(spark, sf):
    return schema.validate_upload(spoilt(spark, sf).rows, problems="problems")


@query("write_clean", f"WITH {HOURLY_SQL} SELECT {ALL} FROM hourly")
def write_clean(spark, sf):
    source = readings.hourly(spark, sf)
    path = sinks.write_readings(source, new_path(spark, "readings"))
    return sinks.read_back(spark, path, source)


@query("write_clean_csv", f"WITH {DAILY_SQL} SELECT station, datetime, {rounded(DS)} FROM daily")
def write_clean_csv(spark, sf):
    source = readings.daily(spark, sf)
    path = sinks.write_readings(source, new_path(spark, "daily-csv"), fmt="csv", partitioned=False)
    return sinks.read_back(spark, path, source, fmt="csv")


@query("preview", f"WITH {HOURLY_SQL} SELECT {ALL} FROM hourly ORDER BY datetime, station LIMIT 10")
def preview(spark, sf):
    return rel.preview(readings.hourly(spark, sf), HOURS, 10)


RAW_SQL = """raw AS (SELECT CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE strftime(ts, '%d/%m/%Y %H:%M') END AS raw,
  event_id, user_id, value FROM events)"""


def raw_times(spark, sf):
    """Events with their time as text, one in ten unreadable."""
    e = readings.table(spark, sf, "events")
    text = F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm"))
    return e.select(text.alias("raw"), "event_id", "user_id", "value")


@query("detect_datetime_col", """
SELECT 'o_orderdate' AS "column", 'name' AS rule, avg(CASE WHEN o_orderdate IS NOT NULL THEN 1.0 ELSE 0.0 END) AS parsed_share FROM orders
UNION ALL SELECT CASE WHEN s > 0.8 THEN 'c1' END, CASE WHEN s > 0.8 THEN 'content' ELSE 'none' END, round(s, 6)
FROM (SELECT avg(CASE WHEN TRY_CAST(CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE ts::VARCHAR END AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS s FROM events)
UNION ALL SELECT NULL, 'none', 0.0 FROM (SELECT count(*) FROM part)""")
def detect_datetime_col(spark, sf):
    by_name = schema.detect_datetime_col(readings.table(spark, sf, "orders"))
    e = readings.table(spark, sf, "events")
    text = F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.col("ts").cast("string"))
    by_content = schema.detect_datetime_col(e.select(text.alias("c1"), "value"))
    p = readings.table(spark, sf, "part")
    neither = schema.detect_datetime_col(p.select("p_name", "p_brand"))
    return by_name.unionByName(by_content).unionByName(neither)


_FORMATS = ("%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M", "%m/%d/%Y %H:%M", "%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%m/%d/%Y")
_TRIES = ", ".join(["TRY_CAST(raw AS TIMESTAMP) AS t0"] + [f"try_strptime(raw, '{f}') AS t{i + 1}" for i, f in enumerate(_FORMATS)])
PARSED_SQL = f"""{RAW_SQL}, tries AS (SELECT *, {_TRIES} FROM raw),
shares AS (SELECT {", ".join(f"count(t{i}) / count(*)::DOUBLE AS s{i}" for i in range(8))} FROM tries),
parsed AS (SELECT event_id, user_id, value, CASE {" ".join(f"WHEN s{i} > 0.8 THEN t{i}" for i in range(8))} END AS datetime
FROM tries, shares)"""


@query("parse_datetime_multi", f"WITH {PARSED_SQL} SELECT event_id, user_id, value, datetime FROM parsed")
def parse_datetime_multi(spark, sf):
    return schema.parse_datetime(raw_times(spark, sf), "raw").drop("raw")


@query("filter_valid_ts", f"WITH {PARSED_SQL} SELECT event_id, user_id, value, datetime FROM parsed WHERE datetime IS NOT NULL")
def filter_valid_ts(spark, sf):
    return rel.filter_valid_ts(schema.parse_datetime(raw_times(spark, sf), "raw").drop("raw"))


@query("synth_datetime", """SELECT event_id, value,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(row_number() OVER (ORDER BY event_id) - 1) AS datetime FROM events""")
def synth_datetime(spark, sf):
    e = readings.table(spark, sf, "events").select("event_id", "value")
    order = Series(keys=(), ts="event_id", chunk=1_000_000)
    return grid.synth_datetime(e, order, "2024-01-01 00:00:00")


@query("map_measure_cols", f"""WITH {HOURLY_SQL} SELECT station, datetime, {r("coalesce(pm2_5, pm10)", "pm2_5")},
  {r("no2")}, {r("so2")}, {r("co")}, {r("pm10", '"CO2"')} FROM hourly""")
def map_measure_cols(spark, sf):
    h = readings.hourly(spark, sf)
    messy = h.select("station", "datetime", F.col("pm2_5").alias("PM 2.5"), F.col("pm10").alias("PM25_backup"),
                     F.col("no2").alias("N.O2"), F.col("so2").alias("so_2"), F.col("co").alias("Carbon Monoxide"),
                     F.col("pm10").alias("CO2"))
    return schema.map_measure_cols(messy)


@query("validate_upload", f"""WITH {HOURLY_SQL}, n AS (SELECT count(*) AS n FROM hourly)
SELECT 'not_empty' AS rule, n > 0 AS ok, n::VARCHAR AS detail FROM n
UNION ALL SELECT 'min_rows', n >= 50, n::VARCHAR FROM n
UNION ALL SELECT 'has_datetime', true, 'datetime' FROM n
UNION ALL SELECT 'has_measure', true, 'pm2_5,pm10,no2,so2,co' FROM n
{each("UNION ALL SELECT 'numeric_{m}', true, 'double' FROM n", MS, " ")}""")
def validate_upload(spark, sf):
    return schema.validate_upload(readings.hourly(spark, sf))


@query("range_validate", f"""WITH {HOURLY_SQL}, {long_sql()}, ranges(measure, low, high) AS
(VALUES ('pm2_5', 0.0::DOUBLE, 500.0::DOUBLE), ('pm10', 0.0, 1000.0), ('no2', 0.0, 500.0), ('so2', 0.0, 500.0), ('co', 0.0, 50.0))
SELECT station, measure, low, high, count(*) FILTER (WHERE value < low OR value > high) AS out_of_range
FROM long JOIN ranges USING (measure) GROUP BY ALL""")
def range_check(spark, sf):
    return range_validate(readings.hourly(spark, sf), MS, ("station",))


@query("model_compat", f"""WITH {HOURLY_SQL}, {long_sql()}
SELECT station, measure, count(value) AS "values", count(value) > 0 AS has_data, measure IN ('pm2_5', 'pm10', 'co') AS has_model
FROM long GROUP BY 1, 2""")
def model_compat(spark, sf):
    models = spark.createDataFrame([(m, m in ("pm2_5", "pm10", "co")) for m in MS], "measure string, has_model boolean")
    return schema.model_compat(readings.hourly(spark, sf), MS, models)


@query("align_features", f"WITH {HOURLY_SQL} SELECT station, datetime, {r('co')}, 0.0::DOUBLE AS o3, {r('pm2_5')} FROM hourly")
def align_features(spark, sf):
    return rel.align_features(readings.hourly(spark, sf), ["co", "o3", "pm2_5"], keep=["station", "datetime"])


@query("numeric_only", "SELECT event_id, user_id FROM events")
def numeric_only(spark, sf):
    return rel.numeric_only(readings.table(spark, sf, "events"), drop=["value"])


@query("project_measures", f"WITH {HOURLY_SQL} SELECT datetime, {rounded(MS)}, station FROM hourly")
def project_measures(spark, sf):
    return readings.project_measures(readings.hourly(spark, sf).withColumn("note", F.lit("x")))


@query("dropna_subset", f"WITH {HOURLY_SQL} SELECT {ALL} FROM hourly WHERE pm2_5 IS NOT NULL AND co IS NOT NULL")
def dropna_subset(spark, sf):
    return rel.dropna_subset(readings.hourly(spark, sf), ["pm2_5", "co"])


@query("dropna_any", f"WITH {HOURLY_SQL} SELECT {ALL} FROM hourly WHERE {each('{m} IS NOT NULL', MS, ' AND ')}")
def dropna_any(spark, sf):
    return rel.dropna_any(readings.hourly(spark, sf))


@query("sort_ts", f"WITH {HOURLY_SQL} SELECT {ALL} FROM hourly ORDER BY station, datetime")
def sort_ts(spark, sf):
    return rel.sort_ts(readings.hourly(spark, sf), HOURS)


@query("latest_reading", f"""WITH {HOURLY_SQL} SELECT {ALL} FROM hourly
QUALIFY row_number() OVER (PARTITION BY station ORDER BY datetime DESC) = 1""")
def latest_reading(spark, sf):
    return rel.latest_reading(readings.hourly(spark, sf), HOURS)


@query("tail_n", f"""WITH {DAILY_SQL} SELECT station, datetime, {rounded(DS)} FROM daily
QUALIFY row_number() OVER (PARTITION BY station ORDER BY datetime DESC) <= 24""")
def tail_n(spark, sf):
    return rel.tail_n(readings.daily(spark, sf), DAYS, 24)


# ---- joins and unions ----

@query("grid_left_join", f"WITH {HOURLY_SQL}, {grid_sql('hourly', 'grid')} SELECT {ALL} FROM grid")
def grid_left_join(spark, sf):
    return grid.grid_left_join(hourly(spark, sf), HOURS)


def predictions(spark, sf):
    filled = materialize(interpolate(hourly(spark, sf), HOURS, MS))
    return scoring.persistence(filled, HOURS, MS)


@query("actual_lookup", f"""WITH {PREDICTIONS_SQL}, {long_sql()}
SELECT station, datetime, measure, {r("predicted")}, {r("value")} FROM predictions JOIN long USING (station, datetime, measure)""")
def actual_lookup(spark, sf):
    h = hourly(spark, sf)
    filled = materialize(interpolate(h, HOURS, MS))
    made = scoring.persistence(filled, HOURS, MS).drop("actual")
    return rel.actual_lookup(made, to_long(h, MS, ["station", "datetime"]), HOURS)


@query("combine_predictions", f"""WITH {PREDICTIONS_SQL} SELECT h.station, h.datetime, {each(r("any_value(h.{m})", "{m}"))},
{each(r("max(p.predicted) FILTER (WHERE p.measure = '{m}')", "{m}_predicted"))}
FROM hourly h LEFT JOIN predictions p ON h.station = p.station AND h.datetime = p.datetime GROUP BY 1, 2""")
def combine_predictions(spark, sf):
    h = hourly(spark, sf)
    filled = materialize(interpolate(h, HOURS, MS))
    return rel.combine_predictions(h, scoring.persistence(filled, HOURS, MS), HOURS, MS)


@query("ordered_dim_join", f"""WITH {DAILY_SQL}, months AS (SELECT monthname(datetime) AS month, month(datetime) - 1 AS position, count(*) AS n
FROM daily GROUP BY 1, 2) SELECT position, month, n FROM months""")
def ordered_dim_join(spark, sf):
    by_month = readings.daily(spark, sf).groupBy(F.date_format("datetime", "MMMM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))
    return rel.month_dim(by_month)


@query("append_rows", f"""WITH {HOURLY_SQL}, last AS (SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY station ORDER BY datetime DESC) = 1)
SELECT {ALL} FROM hourly UNION ALL SELECT station, datetime + INTERVAL 1 HOUR, {rounded(MS)} FROM last""")
def append_rows(spark, sf):
    h = hourly(spark, sf)
    more = rel.latest_reading(h, HOURS).withColumn("datetime", F.col("datetime") + F.expr("INTERVAL 1 HOUR"))
    return rel.append_rows(h, more)


@query("history_plus_forecast", f"""WITH {FILLED_SQL}, {long_sql('filled')}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY station, measure ORDER BY datetime DESC) AS rn FROM long)
SELECT station, datetime, measure, {r("value")}, 'Historical' AS series FROM ranked WHERE rn <= 168
UNION ALL SELECT station, datetime + to_hours(i), measure, {rr('value')}, 'Forecast' FROM ranked, range(1, 25) t(i)
WHERE rn = 1 AND value IS NOT NULL""")
def history_plus_forecast(spark, sf):
    filled = materialize(interpolate(hourly(spark, sf), HOURS, MS))
    ahead = scoring.naive_forecast(filled, HOURS, MS, 24)
    return rel.history_plus_forecast(filled, ahead, HOURS, MS, 168)
