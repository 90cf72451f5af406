"""Streaming twins, run over everything that is there, against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysense.queries.air import CAT, COLOR, aqi_sql
from skysense.queries.common import HOURLY_SQL, query, r, rounded
from skysense.queries.tables import MS
from skysense.streaming import feeds

# Windows that the watermark, two hours behind the newest event, has passed.
CLOSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


@query("stream_hourly_means", f"WITH {HOURLY_SQL} SELECT station, datetime, {rounded(MS)} FROM hourly WHERE datetime + INTERVAL 1 HOUR <= {CLOSED}")
def stream_hourly_means(spark, sf):
    return feeds.run_available(feeds.hourly_means(feeds.event_stream(spark, sf)), "hourly-means")


@query("stream_hourly_aqi", f"""WITH {HOURLY_SQL}, a AS (SELECT *, {aqi_sql('pm2_5', 'NULL')} AS aqi FROM hourly WHERE datetime + INTERVAL 1 HOUR <= {CLOSED})
SELECT station, datetime, {rounded(MS)}, aqi, {CAT} AS category, {COLOR} AS color FROM a WHERE aqi > 100""")
def stream_hourly_aqi(spark, sf):
    return feeds.run_available(feeds.hourly_aqi_alerts(feeds.event_stream(spark, sf)), "hourly-aqi")


@query("stream_dedupe", "SELECT DISTINCT user_id % 4 AS station, event_type, date_trunc('hour', ts) AS ts, true AS of_that_hour FROM events")
def stream_dedupe(spark, sf):
    """First arrival per station, type and hour. Which event that is depends on arrival, so
    the result says only whether the event that stayed is one of that hour."""
    events = feeds.event_stream(spark, sf).withColumn("at", F.col("ts"))
    by_hour = events.withColumn("ts", feeds.hour_of("ts"))
    first = feeds.run_available(feeds.dedupe(by_hour, ("station", "event_type", "ts")), "dedupe")
    kept = F.col("event_id").isNotNull() & F.col("value").isNotNull() & (feeds.hour_of("at") == F.col("ts"))
    return first.select("station", "event_type", "ts", kept.alias("of_that_hour"))


@query("stream_first_event", f"""SELECT user_id % 4 AS station, event_type, date_trunc('hour', ts) AS window_start, min(ts) AS ts,
  arg_min(event_id, (ts, event_id)) AS event_id, {r("arg_min(value, (ts, event_id))", "value")} FROM events
GROUP BY 1, 2, 3 HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= {CLOSED}""")
def stream_first_event(spark, sf):
    """The first event by time and identifier of each station, type and hour, whatever arrived first."""
    first = feeds.run_available(feeds.first_events(feeds.event_stream(spark, sf)), "first-events")
    return first.select("station", "event_type", "window_start", "ts", "event_id", "value")


@query("stream_sliding_mean", f"""WITH e AS (SELECT user_id % 4 AS station, event_type, ts, value FROM events),
w AS (SELECT station, event_type, value, date_trunc('hour', ts) - to_hours(i) AS window_start FROM e, range(0, 24) t(i))
SELECT station, event_type, window_start, window_start + INTERVAL 24 HOUR AS window_end, {r("avg(value)", "mean")}, count(*) AS n FROM w
WHERE window_start + INTERVAL 24 HOUR <= {CLOSED} GROUP BY 1, 2, 3""")
def stream_sliding_mean(spark, sf):
    return feeds.run_available(feeds.sliding_means(feeds.event_stream(spark, sf)), "sliding")
