"""Rows that must not get lost: NULL keys, NULL orders, unreadable times, tables in several files."""

import pytest
from pyspark.sql import functions as F

from skysense.operators import features, grid, impute, relational, scaling
from skysense.plans import cleaning
from skysense.queries import QUERIES
from skysense.series import Series
from skysense.session import attach, materialize
from tests.conftest import SMALL, at

HOURS = Series(chunk=24 * 3600)


@pytest.fixture(scope="module")
def nameless(spark):
    """Ten rows of a station, ten rows without one."""
    rows = [(k, at(i), i, float(i) if i % 3 else None) for k in (1, None) for i in range(10)]
    return materialize(spark.createDataFrame(rows, "station int, datetime timestamp_ntz, seq int, m double"))


@pytest.mark.parametrize("run", [
    lambda d: features.lag_features(d, HOURS, ["m"]), lambda d: scaling.split_time(d, HOURS),
    lambda d: impute.interpolate(d, HOURS, ["m"]), lambda d: features.lag_features(d, HOURS, ["m"], step=3600)])
def test_ordering_rows_without_a_key_fails(nameless, run):
    with pytest.raises(Exception, match="no place in a series"):
        run(nameless).collect()
    named = nameless.fillna({"station": -1})
    assert run(named).count() == 20


def test_joins_find_rows_without_a_key(spark, nameless):
    full = grid.grid_left_join(nameless, HOURS)
    assert full.count() == 20 and full.filter("station IS NULL AND seq IS NOT NULL").count() == 10
    params = nameless.groupBy("station").agg(F.max("m").alias("top"))
    for most in (1 << 20, 0):
        joined = attach(nameless, params, ("station",), max_bytes=most)
        assert joined.filter("station IS NULL AND top = 8.0").count() == 10
    made = nameless.select("station", "datetime", F.lit("m").alias("measure"), F.lit(1.0).alias("predicted"))
    assert relational.combine_predictions(nameless, made, HOURS, ["m"]).filter("m_predicted = 1.0").count() == 20
    assert grid.daily_counts(nameless, HOURS).filter("n = 10").count() == 2


def test_first_row_without_an_order(spark):
    rows = [(1, at(0), None, 5.0), (1, at(0), None, 5.0), (1, at(1), None, 6.0), (1, at(1), 3, 7.0)]
    df = spark.createDataFrame(rows, "station int, datetime timestamp_ntz, seq int, m double")
    assert sorted((r.datetime, r.m) for r in grid.dedupe_first(df, HOURS, "seq").collect()) == [(at(0), 5.0), (at(1), 7.0)]


def test_unknown_fill_names_fail(nameless):
    with pytest.raises(ValueError, match="unknown fill method"):
        impute.fill_missing(nameless, HOURS, ["m"], "medain")
    filled = impute.fill_missing(nameless, HOURS, ["m"], "median")
    assert filled.count() == 20 and filled.filter("m IS NULL").count() == 0


def test_uploads_keep_their_rows(spark):
    rows = [(i, f"day {i}", "w", float(i), 1) for i in range(60)]
    df = spark.createDataFrame(rows, "row int, `Date` string, width string, pm2_5 double, station int")
    got = cleaning.prepare_upload(df, HOURS, seq="row", start="2024-01-01 00:00:00").orderBy("datetime").collect()
    assert [(r.datetime, r.pm2_5) for r in got] == [(at(i), float(i)) for i in range(60)]
    readable = df.withColumn("Date", F.expr("date_format(timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, row), 'dd/MM/yyyy HH:mm')"))
    assert cleaning.prepare_upload(readable, HOURS).count() == 60
    numbers = df.select("pm2_5", "station", "row")
    assert cleaning.prepare_upload(numbers, HOURS, seq="row").count() == 60
    with pytest.raises(Exception, match="no known time format"):
        cleaning.clean(df, HOURS, "row").data.collect()
    with pytest.raises(ValueError, match="no time column"):
        cleaning.clean(numbers, HOURS, "row")


def test_streams_read_folders(spark, tmp_path):
    folder = str(tmp_path / "sf")
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(3).write.parquet(f"{folder}/events.parquet")
    for name in ("stream_hourly_means", "stream_hourly_aqi", "stream_sliding_mean"):
        one, many = (sorted(map(repr, QUERIES[name](spark, f).collect())) for f in (SMALL, folder))
        assert one and one == many
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        QUERIES["stream_hourly_means"](spark, str(tmp_path / "none"))
