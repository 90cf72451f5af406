"""Statistics, patterns, quality and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysense.operators import features, grid, profile
from skysense.plans import reports
from skysense.queries.cleaning import CLEAN_LOG_CTES, CLEAN_LOG_SELECT, MESSY_SQL, messy
from skysense.queries.common import (
    DAILY_SQL, DAYS, DS, HOURLY_SQL, HOURS, MS, NUDGE, daily, each, hourly, long_sql, query, r, rounded,
)
from skysense.queries.feature import rolling_sql
from skysense.session import new_path
from skysense.sources import readings, sinks

LONG = f"{HOURLY_SQL}, {long_sql()}"
DLONG = f"{DAILY_SQL}, {long_sql('daily', DS)}"
MISSING = "count(*) FILTER (WHERE value IS NULL) * 100.0::DOUBLE / count(*)"
CV = "CASE WHEN avg(value) > 0 THEN stddev_samp(value) / avg(value) * 100 ELSE 0.0 END"


def q(p: float) -> str:
    return f"quantile_cont(value, {p})"


def literals(measures, col="measure") -> str:
    return "list_position([" + ", ".join(f"'{m}'" for m in measures) + f"], {col})"


@query("describe", f"""WITH {LONG} SELECT station, measure, count(value) AS count, {r("avg(value)", "mean")}, {r("stddev_samp(value)", "std")},
  {r("min(value)", "min")}, {r(q(0.25), "q25")}, {r(q(0.5), "median")}, {r(q(0.75), "q75")}, {r("max(value)", "max")}, {r(MISSING, "missing_pct")}
FROM long GROUP BY 1, 2""")
def describe(spark, sf):
    return profile.describe(hourly(spark, sf), MS, ("station",))


@query("describe_daily", f"""WITH {DLONG} SELECT measure, count(value) AS count, {r("avg(value)", "mean")}, {r("stddev_samp(value)", "std")},
  {r("min(value)", "min")}, {r(q(0.25), "q25")}, {r(q(0.5), "median")}, {r(q(0.75), "q75")}, {r("max(value)", "max")}, {r(MISSING, "missing_pct")}
FROM long GROUP BY 1""")
def describe_daily(spark, sf):
    """All stations as one group, large enough for the bracketed quantiles."""
    return profile.describe(daily(spark, sf), DS)


SUMMARY_SQL = f"""stats AS (SELECT measure, count(*) AS total_rows, min(datetime) AS start, max(datetime) AS "end", avg(value) AS mean,
  stddev_samp(value) AS std, min(value) AS min, max(value) AS max, median(value) AS median, round({MISSING}, 2) AS missing_pct FROM long GROUP BY 1),
overall AS (SELECT CASE WHEN avg(missing_pct) > 20 THEN 'Poor' WHEN avg(missing_pct) > 10 THEN 'Fair' ELSE 'Good' END AS data_quality,
  avg(missing_pct) AS avg_missing FROM stats),
summary AS (SELECT stats.*, data_quality, avg_missing,
  CASE WHEN missing_pct < 5 THEN 'Good' WHEN missing_pct < 15 THEN 'Fair' ELSE 'Poor' END AS measure_quality FROM stats, overall)"""


@query("upload_summary", f"""WITH {LONG}, {SUMMARY_SQL} SELECT measure, total_rows, start, "end", {rounded(["mean", "std", "min", "max", "median", "missing_pct"])},
  data_quality, measure_quality FROM summary""")
def upload_summary(spark, sf):
    return profile.upload_summary(hourly(spark, sf), MS)


@query("quality_label", f"""WITH {LONG}, s AS (SELECT station, measure, {MISSING} AS missing_pct FROM long GROUP BY 1, 2)
SELECT station, measure, {r("missing_pct")}, CASE WHEN missing_pct < 5 THEN 'Good' WHEN missing_pct < 15 THEN 'Fair' ELSE 'Poor' END AS measure_quality,
  CASE WHEN avg(missing_pct) OVER (PARTITION BY station) > 20 THEN 'Poor' WHEN avg(missing_pct) OVER (PARTITION BY station) > 10 THEN 'Fair' ELSE 'Good' END AS data_quality FROM s""")
def quality_label(spark, sf):
    share = profile.missing_profile(readings.hourly(spark, sf), MS, ("station",))
    overall = share.groupBy("station").agg(profile.quality_label(F.avg("missing_pct")).alias("data_quality"))
    return share.join(overall, "station").select(
        "station", "measure", "missing_pct", profile.measure_quality(F.col("missing_pct")).alias("measure_quality"), "data_quality")


@query("percentiles", f"""WITH {LONG} SELECT station, measure, p::BIGINT AS percentile, {r("v", "value")} FROM (
  SELECT station, measure, unnest([10, 25, 50, 75, 90, 95, 99]) AS p,
  unnest(quantile_cont(value, [0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99])) AS v FROM long GROUP BY 1, 2)""")
def percentiles(spark, sf):
    return profile.percentiles(hourly(spark, sf), MS, ("station",))


@query("percentiles_events", f"""SELECT event_type, 'value' AS measure, p::BIGINT AS percentile, {r("v", "value")} FROM (
  SELECT event_type, unnest([10, 25, 50, 75, 90, 95, 99]) AS p,
  unnest(quantile_cont(value, [0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99])) AS v FROM events GROUP BY 1)""")
def percentiles_events(spark, sf):
    """Straight over the event table, without hourly means in between."""
    e = readings.table(spark, sf, "events").select("event_type", "value")
    return profile.percentiles(e, ["value"], ("event_type",))


@query("skewness", f"WITH {LONG} SELECT station, measure, {r('skewness(value)', 'skewness')} FROM long GROUP BY 1, 2")
def skewness(spark, sf):
    return profile.skewness(readings.hourly(spark, sf), MS, ("station",))


@query("coef_variation", f"WITH {LONG} SELECT station, measure, {r(CV, 'cv_pct')} FROM long GROUP BY 1, 2")
def coef_variation(spark, sf):
    return profile.coefficient_of_variation(readings.hourly(spark, sf), MS, ("station",))


@query("histogram", f"""WITH {LONG}, lim AS (SELECT measure, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1),
b AS (SELECT measure, lo, hi, least(floor(coalesce((value - lo) / nullif(hi - lo, 0), 0) * 50) + 1, 50)::BIGINT AS bin, count(*) AS n
FROM long JOIN lim USING (measure) WHERE value IS NOT NULL GROUP BY ALL)
SELECT measure, bin, {r("lo + (hi - lo) / 50 * (bin - 1)", "bin_start")}, {r("lo + (hi - lo) / 50 * bin", "bin_end")}, n FROM b""")
def histogram(spark, sf):
    return profile.histogram(hourly(spark, sf), MS)


@query("box_stats", f"""WITH {LONG}, b AS (SELECT station, measure, {q(0.25)} AS q1, {q(0.5)} AS median, {q(0.75)} AS q3 FROM long GROUP BY 1, 2)
SELECT station, measure, {r("q1")}, {r("median")}, {r("q3")},
  {r("min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1))", "whisker_low")}, {r("max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1))", "whisker_high")},
  count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outside
FROM long JOIN b USING (station, measure) WHERE value IS NOT NULL GROUP BY station, measure, q1, median, q3""")
def box_stats(spark, sf):
    return profile.box_stats(hourly(spark, sf), MS, ("station",))


def pairs_sql(src: str, measures, keys: str = "") -> str:
    out = []
    for i, a in enumerate(measures):
        for b in measures[i + 1:]:
            group = f"GROUP BY {keys}" if keys else ""
            lead = f"{keys}, " if keys else ""
            out.append(f"SELECT {lead}'{a}' AS measure_1, '{b}' AS measure_2, CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS corr FROM {src} {group}")
    return "pairs AS (" + " UNION ALL ".join(out) + ")"


@query("corr_matrix", f"WITH {HOURLY_SQL}, {pairs_sql('hourly', MS, 'station')} SELECT station, measure_1, measure_2, {r('corr')} FROM pairs")
def corr_matrix(spark, sf):
    return profile.corr_matrix(readings.hourly(spark, sf), MS, ("station",))


SMOOTHED = ("price", "price_rolling_mean_3", "price_rolling_mean_6", "price_rolling_mean_12")


@query("strong_corr", f"""WITH {DAILY_SQL}, smooth AS (SELECT *, {rolling_sql('price', (3, 6, 12), ('mean',))} FROM daily),
{pairs_sql('smooth', SMOOTHED)} SELECT measure_1, measure_2, {r('corr')},
  CASE WHEN abs(corr) > 0.8 THEN 'Very Strong' WHEN abs(corr) > 0.6 THEN 'Strong' ELSE 'Moderate' END AS strength,
  CASE WHEN corr > 0 THEN 'Positive' ELSE 'Negative' END AS direction FROM pairs WHERE abs(corr) > 0.5""")
def strong_corr(spark, sf):
    """Between a measure and its rolling means: independent measures have no strong pairs here."""
    smooth = features.rolling_features(daily(spark, sf), DAYS, ["price"], (3, 6, 12))
    return profile.strong_corr(smooth, SMOOTHED)


@query("weak_corr", f"""WITH {HOURLY_SQL}, {pairs_sql('hourly', MS, 'station')} SELECT station, measure_1, measure_2, {r('corr')},
  CASE WHEN abs(corr) > 0.8 THEN 'Very Strong' WHEN abs(corr) > 0.6 THEN 'Strong' ELSE 'Moderate' END AS strength,
  CASE WHEN corr > 0 THEN 'Positive' ELSE 'Negative' END AS direction FROM pairs WHERE abs(corr) > 0.02""")
def weak_corr(spark, sf):
    """The same report with a threshold that the given readings reach."""
    return profile.strong_corr(readings.hourly(spark, sf), MS, ("station",), threshold=0.02)


HOURS_SQL = "byhour AS (SELECT station, hour(datetime)::BIGINT AS hour, measure, avg(value) AS mean, stddev_samp(value) AS std FROM long GROUP BY 1, 2, 3)"


@query("hourly_pattern", f"""WITH {LONG}, {HOURS_SQL} SELECT station, hour, measure, {r("mean")}, {r("std")}, {r("mean - std", "lower")}, {r("mean + std", "upper")} FROM byhour""")
def hourly_pattern(spark, sf):
    return profile.hourly_pattern(readings.hourly(spark, sf), MS, keys=("station",))


@query("argmax_hour", f"""WITH {LONG}, {HOURS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY station, measure ORDER BY mean DESC NULLS LAST, hour) AS hi,
  row_number() OVER (PARTITION BY station, measure ORDER BY mean ASC NULLS LAST, hour) AS lo FROM byhour),
p AS (SELECT station, measure, max(hour) FILTER (WHERE hi = 1) AS peak_hour, max(mean) FILTER (WHERE hi = 1) AS peak_mean,
  max(hour) FILTER (WHERE lo = 1) AS low_hour, max(mean) FILTER (WHERE lo = 1) AS low_mean FROM o GROUP BY 1, 2)
SELECT station, measure, peak_hour, {r("peak_mean")}, low_hour, {r("low_mean")}, {r("(peak_mean - low_mean) / nullif(low_mean, 0) * 100", "peak_to_low_pct")} FROM p""")
def argmax_hour(spark, sf):
    return profile.peak_hours(readings.hourly(spark, sf), MS, keys=("station",))


TOP_SQL = f"""s AS (SELECT station, measure, avg(value) AS mean, stddev_samp(value) AS std FROM long GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY mean DESC NULLS LAST, {literals(MS)}) AS a,
  row_number() OVER (PARTITION BY station ORDER BY std DESC NULLS LAST, {literals(MS)}) AS b FROM s)"""


@query("argmax_measure", f"""WITH {LONG}, {TOP_SQL} SELECT station, max(measure) FILTER (WHERE a = 1) AS highest_measure, {r("max(mean)", "highest_mean")},
  max(measure) FILTER (WHERE b = 1) AS most_variable, {r("max(std)", "highest_std")} FROM o GROUP BY 1""")
def argmax_measure(spark, sf):
    return profile.top_measures(readings.hourly(spark, sf), MS, ("station",))


@query("weekday_pattern", f"""WITH {HOURLY_SQL}, names AS (SELECT unnest(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']) AS weekday, unnest(range(0, 7)) AS position),
w AS (SELECT dayname(datetime) AS weekday, {each("avg({m}) AS {m}")} FROM hourly GROUP BY 1)
SELECT weekday, position, {rounded(MS)} FROM names LEFT JOIN w USING (weekday)""")
def weekday_pattern(spark, sf):
    return profile.weekday_pattern(readings.hourly(spark, sf), MS)


@query("monthly_pattern", f"""WITH {DAILY_SQL}, m AS (SELECT monthname(datetime) AS month, month(datetime) - 1 AS position, {each("avg({m}) AS {m}", DS)} FROM daily GROUP BY 1, 2)
SELECT month, position, {rounded(DS)} FROM m WHERE (SELECT count(*) FROM m) > 3""")
def monthly_pattern(spark, sf):
    return profile.monthly_pattern(readings.daily(spark, sf), DS)


@query("weekend_filter_compare", f"""WITH {LONG}, w AS (SELECT station, measure, avg(value) FILTER (WHERE isodow(datetime) < 6) AS a, avg(value) FILTER (WHERE isodow(datetime) >= 6) AS b FROM long GROUP BY 1, 2)
SELECT station, measure, {r("a", "weekday_mean")}, {r("b", "weekend_mean")}, {r("(b - a) / nullif(a, 0) * 100", "difference_pct")} FROM w""")
def weekend_filter_compare(spark, sf):
    return profile.weekend_compare(readings.hourly(spark, sf), MS, keys=("station",))


@query("daily_counts", """WITH d AS (SELECT l_suppkey AS station, date_trunc('day', l_shipdate)::TIMESTAMP AS day, count(*) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT station, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM d GROUP BY station)
SELECT s.station, s.day, coalesce(n, 0) AS n FROM s LEFT JOIN d ON d.station = s.station AND d.day = s.day""")
def daily_counts(spark, sf):
    li = readings.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("station"), F.col("l_shipdate").alias("datetime"))
    return grid.daily_counts(li, DAYS)


@query("missing_profile", f"WITH {LONG} SELECT station, measure, count(*) FILTER (WHERE value IS NULL) AS missing, {r(MISSING, 'missing_pct')} FROM long GROUP BY 1, 2")
def missing_profile(spark, sf):
    return profile.missing_profile(readings.hourly(spark, sf), MS, ("station",))


GONE = each("count(*) FILTER (WHERE {m} IS NULL)", MS, " + ")


@query("completeness", f"""WITH {HOURLY_SQL}, c AS (SELECT station, count(*) AS "rows", {GONE} AS missing FROM hourly GROUP BY 1),
p AS (SELECT *, ("rows" * 5 - missing) * 100.0::DOUBLE / ("rows" * 5) AS pct FROM c)
SELECT station, "rows", missing, {r("pct", "completeness_pct")}, CASE WHEN pct >= 95 THEN 'Excellent' WHEN pct >= 85 THEN 'Good' ELSE 'Concerns' END AS grade FROM p""")
def completeness(spark, sf):
    return profile.completeness(readings.hourly(spark, sf), MS, ("station",))


@query("time_coverage", """SELECT l_suppkey AS station, min(l_shipdate) AS start, max(l_shipdate) AS "end", count(*) AS points,
  floor((epoch(max(l_shipdate)) - epoch(min(l_shipdate))) / 86400)::BIGINT AS span_days FROM lineitem GROUP BY 1""")
def time_coverage(spark, sf):
    li = readings.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("station"), F.col("l_shipdate").alias("datetime"))
    return profile.time_coverage(li, keys=("station",))


OUT_SQL = f"""fences AS (SELECT station, measure, {q(0.25)} AS a, {q(0.75)} AS b FROM long GROUP BY 1, 2),
base AS (SELECT station, measure, {MISSING} AS missing_pct, {CV} AS cv_pct,
  count(*) FILTER (WHERE value < a - 3 * (b - a) OR value > b + 3 * (b - a)) AS outliers,
  count(*) FILTER (WHERE value < a - 3 * (b - a) OR value > b + 3 * (b - a)) * 100.0::DOUBLE / count(*) AS outlier_pct
  FROM long JOIN fences USING (station, measure) GROUP BY 1, 2)"""


@query("quality_score", f"""WITH {LONG}, {OUT_SQL}, sc AS (SELECT *, 100 - missing_pct AS completeness,
  (100 - missing_pct) * 0.5 + greatest(0, 100 - outlier_pct * 5) * 0.3 + greatest(0, 100 - least(cv_pct, 100)) * 0.2 AS score FROM base),
o AS (SELECT station, avg(round(score, 1)) AS overall_score FROM sc GROUP BY 1)
SELECT station, measure, {rounded(["missing_pct", "cv_pct", "outlier_pct", "completeness", "score", "overall_score"])},
  CASE WHEN overall_score >= 90 THEN 'Excellent' WHEN overall_score >= 75 THEN 'Good' WHEN overall_score >= 60 THEN 'Fair' ELSE 'Poor' END AS overall_band
FROM sc JOIN o USING (station)""")
def quality_score(spark, sf):
    return profile.quality_score(hourly(spark, sf), MS, ("station",))


STATS = ("mean", "std", "min", "max", "missing_pct", "cv_pct", "q25", "median", "q75", "outlier_pct", "completeness")
STATS_SQL = f"""st AS (SELECT station, measure, count(*) AS total_rows, min(datetime) AS start, max(datetime) AS "end", count(value) AS count, avg(value) AS mean,
  stddev_samp(value) AS std, min(value) AS min, max(value) AS max, count(*) FILTER (WHERE value IS NULL) AS missing_count,
  {q(0.25)} AS q25, {q(0.5)} AS median, {q(0.75)} AS q75 FROM long GROUP BY 1, 2)"""


@query("statistics_struct", f"""WITH {LONG}, {OUT_SQL}, {STATS_SQL} SELECT station, measure, total_rows, start, "end", count, missing_count, outliers,
  floor((epoch("end") - epoch(start)) / 86400)::BIGINT AS span_days, {rounded([s for s in STATS if s != "completeness"])}, {r("100 - missing_pct", "completeness")}
FROM st JOIN base USING (station, measure)""")
def statistics_struct(spark, sf):
    return profile.statistics(hourly(spark, sf), MS, keys=("station",))


@query("export_stats_json", f"""WITH {LONG}, {OUT_SQL}, {STATS_SQL} SELECT station, measure, count, missing_count, {rounded(["mean", "std", "min", "q25", "median", "q75", "max"])}
FROM st""")
def export_stats_json(spark, sf):
    """Written as JSON documents, then read back and taken apart."""
    docs = profile.statistics_json(hourly(spark, sf), MS, keys=("station",))
    labelled = docs.select(F.concat(F.lit('{"station":'), F.col("station").cast("string"), F.lit(',"doc":'), "document", F.lit("}")).alias("document"))
    path = sinks.export_json(labelled, new_path(spark, "stats-json"))
    numbers = ", ".join(f"{c}: double" for c in ("mean", "std", "min", "q25", "median", "q75", "max"))
    shape = f"station long, doc struct<measure_statistics: map<string, struct<count: long, missing_count: long, {numbers}>>>"
    read = spark.read.schema(shape).json(path)
    rows = read.select("station", F.explode("doc.measure_statistics").alias("measure", "s"))
    return rows.select("station", "measure", "s.*")


RAW_CELLS = f"""raw AS (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE date_trunc('hour', ts) END AS datetime, user_id % 4 AS station,
  {", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS {m}" for t, m in readings.EVENT_MEASURES.items())} FROM events)"""


RAW_ROWS = f"""raw_rows AS (SELECT date_trunc('hour', ts) AS datetime, user_id % 4 AS station, event_id,
  {", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS {m}" for t, m in readings.EVENT_MEASURES.items())} FROM events)"""


@query("before_after", f"""WITH {RAW_CELLS}, {MESSY_SQL},
sides AS (SELECT 'before' AS stage, count(*) AS "rows", 7 AS columns, count(*) FILTER (WHERE datetime IS NULL) + {GONE} AS missing, min(datetime) AS start, max(datetime) AS "end" FROM raw
  UNION ALL SELECT 'after', count(*), 7, {GONE}, min(datetime), max(datetime) FROM cleaned)
SELECT stage, "rows", columns::BIGINT AS columns, missing, {r('missing * 100.0::DOUBLE / ("rows" * columns)', "missing_pct")}, start, "end",
  (SELECT "rows" FROM sides WHERE stage = 'after') - (SELECT "rows" FROM sides WHERE stage = 'before') AS row_change FROM sides""")
def before_after(spark, sf):
    from skysense.plans.cleaning import clean

    raw = readings.event_rows(spark, sf).select(
        F.when(F.col("event_id") % 10 != 0, F.col("datetime")).alias("datetime"), "station", *MS)
    return reports.before_after(raw, clean(messy(spark, sf), HOURS, "event_id").data)


def facts_sql(no: int, section: str, src: str, columns: int, missing: str) -> str:
    items = {"total_rows": "count(*)::VARCHAR", "total_columns": f"max('{columns}')", "missing_values": f"({missing})::VARCHAR",
             "missing_pct": f"round(({missing}) * 100.0::DOUBLE / (count(*) * {columns}), 2)::VARCHAR",
             "start": "strftime(min(datetime), '%Y-%m-%d %H:%M:%S')", "end": "strftime(max(datetime), '%Y-%m-%d %H:%M:%S')"}
    return " UNION ALL ".join(f"SELECT {no} AS section_no, '{section}' AS section, '{k}' AS item, {v} AS value FROM {src}" for k, v in items.items())


@query("cleaning_report", f"""WITH {RAW_ROWS}, {MESSY_SQL}, {CLEAN_LOG_CTES}, log AS ({CLEAN_LOG_SELECT})
{facts_sql(1, "original", "raw_rows", 8, GONE)} UNION ALL {facts_sql(2, "cleaned", "cleaned", 7, GONE)}
UNION ALL SELECT 3, 'actions', step || '.' || action || '.' || detail, n::VARCHAR FROM log
UNION ALL SELECT 4, 'summary', 'row_change', ((SELECT count(*) FROM cleaned) - (SELECT count(*) FROM raw_rows))::VARCHAR
UNION ALL SELECT 4, 'summary', 'columns_retained', '7'""")
def cleaning_report(spark, sf):
    from skysense.plans.cleaning import clean

    raw = readings.event_rows(spark, sf)
    done = clean(messy(spark, sf), HOURS, "event_id")
    return reports.cleaning_report(raw, done.data, done.log)


def two(expr: str) -> str:
    return f"(({expr} + {NUDGE})::DECIMAL(20,2))::VARCHAR"


@query("analysis_report", f"""WITH {LONG}, {SUMMARY_SQL}, one AS (SELECT * FROM summary LIMIT 1),
g AS (SELECT measure, avg(value) AS mean, stddev_samp(value) AS std FROM long GROUP BY 1)
SELECT 1 AS section_no, 'overview' AS section, 'total_records' AS item, total_rows::VARCHAR AS value FROM one
UNION ALL SELECT 1, 'overview', 'start', strftime(start, '%Y-%m-%d %H:%M') FROM one
UNION ALL SELECT 1, 'overview', 'end', strftime("end", '%Y-%m-%d %H:%M') FROM one
UNION ALL SELECT 1, 'overview', 'data_quality', data_quality FROM one
UNION ALL SELECT 1, 'overview', 'measures', count(*)::VARCHAR FROM summary
{" ".join(f"UNION ALL SELECT 2, 'statistics', measure || '.{c}', {two(c)} FROM summary" for c in ("mean", "std", "min", "max", "median"))}
UNION ALL SELECT 3, 'quality', measure || '.status', measure_quality FROM summary
UNION ALL SELECT 3, 'quality', measure || '.missing_pct', {two("missing_pct")} FROM summary
UNION ALL SELECT 4, 'insights', 'highest_average', arg_max(measure, mean) FROM g
UNION ALL SELECT 4, 'insights', 'most_variable', arg_max(measure, std) FROM g
UNION ALL SELECT 4, 'insights', 'avg_completeness', ((100 - avg_missing)::DECIMAL(20,1))::VARCHAR FROM one
UNION ALL SELECT 5, 'recommendations', 'quality', CASE data_quality WHEN 'Good' THEN 'Data quality is excellent for predictive modeling'
  WHEN 'Fair' THEN 'Data quality is acceptable with minor gaps' ELSE 'Data quality concerns detected' END FROM one
UNION ALL SELECT 5, 'recommendations', 'missing', 'Significant missing data detected - use interpolated values with caution' FROM one WHERE avg_missing > 10""")
def analysis_report(spark, sf):
    return reports.analysis_report(hourly(spark, sf), MS)
