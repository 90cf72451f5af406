"""Streams over several files: parity with batch, and late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skysense.sources import readings
from skysense.streaming import feeds
from tests.conftest import SMALL, at

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture()
def late(spark, tmp_path):
    """Arrivals in file order; the last one holds a row far behind the watermark.

    A batch drops rows that are late by the watermark before the latest one, so one
    more arrival lies in between.
    """
    rows = [[(1, at(0.2), 0, "click", 10.0, ""), (2, at(0.4), 0, "click", 20.0, "")],
            [(3, at(9), 0, "click", 200.0, "")],
            [(6, at(9.5), 0, "click", 210.0, "")],
            [(4, at(0.6), 0, "click", 99.0, ""), (5, at(20), 0, "click", 1.0, "")]]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def stream_of(spark, path):
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 4).alias("station"),
                      "event_type", "value")


def test_late_rows_are_left_out(spark, late):
    out = feeds.run_available(feeds.hourly_means(stream_of(spark, late)), "late").collect()
    got = {r.datetime: r.pm2_5 for r in out}
    assert got[at(0)] == 15.0 and got[at(9)] == 205.0 and at(20) not in got


def test_alerts_filter_the_index(spark, late):
    out = feeds.run_available(feeds.hourly_aqi_alerts(stream_of(spark, late)), "alerts").collect()
    assert [(r.datetime, r.category) for r in out] == [(at(9), "Very Unhealthy")]


def test_dedupe_within_watermark(spark, tmp_path):
    rows = [(i, at(1), 0, "click", float(i), "") for i in range(5)] + [(9, at(2), 0, "click", 9.0, "")]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(str(tmp_path / "d"))
    out = feeds.run_available(feeds.dedupe(stream_of(spark, str(tmp_path / "d"))), "dedupe")
    assert out.count() == 2


def test_parity_with_batch(spark):
    streamed = feeds.run_available(feeds.hourly_means(feeds.event_stream(spark, SMALL)), "parity")
    newest = readings.table(spark, SMALL, "events").agg(F.max("ts")).first()[0]
    closed = newest - dt.timedelta(hours=3)
    batch = readings.hourly(spark, SMALL).filter(F.col("datetime") <= F.lit(closed).cast("timestamp_ntz"))
    cols = ["station", "datetime", *readings.HOURLY]
    assert sorted(map(repr, streamed.select(*cols).collect())) == sorted(map(repr, batch.select(*cols).collect()))


def test_streamed_hours_feed_the_batch_operators(spark):
    from skysense.operators import impute
    from skysense.series import Series

    streamed = feeds.run_available(feeds.hourly_means(feeds.event_stream(spark, SMALL)), "feed")
    filled = impute.interpolate(streamed, Series(), readings.HOURLY)
    assert filled.filter("pm2_5 is null").count() == 0


def test_first_event_is_by_order_not_by_arrival(spark, tmp_path):
    """The earliest event of an hour comes in the last file that is still in time; ties go to the smaller identifier."""
    files = [[(7, at(0.5), 0, "click", 7.0, ""), (8, at(0.5), 0, "view", 8.0, "")],
             [(3, at(0.2), 0, "click", None, ""), (2, at(0.5), 0, "view", 2.0, "")],
             [(9, at(6), 0, "click", 9.0, "")], [(10, at(12), 0, "click", 1.0, "")]]
    for r in files:
        spark.createDataFrame(r, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    out = feeds.run_available(feeds.first_events(stream_of(spark, str(tmp_path / "f"))), "first").collect()
    assert sorted((r.event_type, r.window_start, r.event_id, r.value) for r in out) == [
        ("click", at(0), 3, None), ("click", at(6), 9, 9.0), ("view", at(0), 2, 2.0)]
