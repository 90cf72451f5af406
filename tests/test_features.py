"""Features, profiles, schema checks, index and scores on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skysense.functions import aqi as fn
from skysense.functions.numeric import sample_skewness
from skysense.operators import air, features, profile, relational, schema, scoring
from skysense.series import Series
from tests.conftest import at, close

HOURS = Series(chunk=5 * 3600, block=30)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    rows = [(k, at(i), float(np.round(rng.uniform(0, 80), 2)), float(i)) for k in (0, 1) for i in range(70)]
    return spark.createDataFrame(rows, "station int, datetime timestamp_ntz, pm2_5 double, pm10 double")


def pandas_of(df):
    return df.orderBy("station", "datetime").toPandas().reset_index(drop=True)


@pytest.mark.parametrize("step", [None, 3600])
def test_rolling_and_lags_match_pandas(series, step):
    made = features.lag_features(features.rolling_features(series, HOURS, ["pm2_5"], (3, 24), step=step), HOURS,
                                 ["pm2_5"], (1, 24), step=step)
    got = pandas_of(made)
    for _, g in got.groupby("station"):
        for w in (3, 24):
            roll = g.pm2_5.rolling(w)
            for stat in ("mean", "std", "min", "max"):
                np.testing.assert_allclose(g[f"pm2_5_rolling_{stat}_{w}"], getattr(roll, stat)(), rtol=1e-9)
        for k in (1, 24):
            np.testing.assert_allclose(g[f"pm2_5_lag_{k}"], g.pm2_5.shift(k))


def test_supervised_features_have_the_documented_columns(series):
    rows = features.supervised_features(series, HOURS, "pm2_5")
    names = features.feature_names("pm2_5", ["pm10"])
    assert rows.columns == ["station", "datetime", "pm2_5", *names] and len(names) == 1 + 24 + 8 + 11
    assert rows.count() == 2 * (70 - 24)
    six = features.feature_names("pm2_5", ["pm10", "no2", "so2", "co", "o3"])
    assert len(six) == 48


def test_sequence_bounds(spark):
    df = spark.createDataFrame([(0, at(i), float(i)) for i in range(8)], "station int, datetime timestamp_ntz, y double")
    seq = features.sequence_windows(df, HOURS, "y", ["y"], lookback=3, horizon=2).orderBy("datetime").collect()
    assert [(r.datetime, [x[0] for x in r.X], r.y) for r in seq] == [
        (at(i), [float(i - 3), float(i - 2), float(i - 1)], float(i + 1)) for i in range(3, 7)]


def test_season_and_weekday(spark):
    df = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-12-31', interval 1 day)) AS datetime")
    got = features.time_features(df).toPandas()
    when = pd.to_datetime(got.datetime)
    assert (got.day_of_week == when.dt.dayofweek).all() and (got.season == (when.dt.month % 12 + 3) // 3).all()
    assert (got.is_weekend == (when.dt.dayofweek >= 5)).all()
    np.testing.assert_allclose(got.month_sin, np.sin(2 * np.pi * when.dt.month / 12), atol=1e-12)


EDGES = [(0.0, 0), (12.0, 50), (12.05, 500), (12.1, 51), (35.4, 100), (35.45, 500), (55.4, 150), (150.4, 200),
         (250.4, 300), (500.0, 500), (500.1, 500), (-1.0, 500)]


def test_index_edges(spark):
    df = spark.createDataFrame([(c, want) for c, want in EDGES] + [(None, None)], "c double, want int")
    for r in df.withColumn("strict", fn.aqi(F.col("c"))).withColumn("nullable", fn.aqi(F.col("c"), mode="nullable")) \
            .withColumn("cut", fn.aqi(F.col("c"), mode="truncate")).withColumn("other", fn.aqi(F.col("c"), "no2")).collect():
        assert r.strict == (500 if r.c is None else r.want) and r.nullable == r.want and r.other is None
        if r.c in (12.05, 35.45):
            assert r.cut == {12.05: 50, 35.45: 100}[r.c]
        if r.c is None or r.c < 0:
            assert r.cut is None


def test_categories_and_advice(spark):
    df = spark.createDataFrame([(i,) for i in (0, 50, 51, 100, 150, 151, 200, 201, 300, 301, None)], "aqi int")
    got = df.select(fn.aqi_category(F.col("aqi"))["category"].alias("c"), fn.health_advice(F.col("aqi")).alias("a")).collect()
    assert [r.c for r in got] == ["Good", "Good", "Moderate", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy",
                                  "Unhealthy", "Very Unhealthy", "Very Unhealthy", "Hazardous", None]
    assert got[0].a.startswith("Air quality is good") and got[5].a.startswith("Air quality is unhealthy") and got[-1].a is None


def test_current_index_without_pm25(spark):
    df = spark.createDataFrame([(0, at(0), 5.0)], "station int, datetime timestamp_ntz, no2 double")
    assert air.aqi_current(df, HOURS).first().aqi == 0


def test_profile_of_degenerate_columns(spark):
    df = spark.createDataFrame([(0, 2.0, None, 1.0), (0, 2.0, None, 3.0), (0, 2.0, None, 8.0), (1, 4.0, 5.0, None)],
                               "station int, same double, none double, some double")
    cols = ["same", "none", "some"]
    d = {(r.station, r.measure): r for r in profile.describe(df, cols, ("station",)).collect()}
    assert d[(0, "none")]["count"] == 0 and d[(0, "none")]["mean"] is None and d[(0, "none")]["missing_pct"] == 100
    assert d[(1, "same")]["std"] is None and d[(0, "same")]["std"] == 0
    assert all(r["corr"] is None for r in profile.corr_matrix(df, cols, ("station",)).collect())
    assert {r["bin"] for r in profile.histogram(df, ["same"], ("station",)).collect()} == {1}
    skew = df.groupBy("station").agg(sample_skewness("some").alias("s"), sample_skewness("same").alias("c"))
    by = {r.station: r for r in skew.collect()}
    assert close(by[0].s, pd.Series([1.0, 3.0, 8.0]).skew()) and by[0].c is None and by[1].s is None
    cv = {(r.station, r.measure): r.cv_pct for r in profile.coefficient_of_variation(df, cols, ("station",)).collect()}
    assert cv[(0, "none")] == 0


def test_months_need_a_minimum(spark):
    df = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-01-15', timestamp_ntz'2024-03-15', interval 1 month)) AS datetime, 1.0D AS m")
    assert profile.monthly_pattern(df, ["m"]).count() == 0
    assert [r.month for r in profile.monthly_pattern(df, ["m"], min_months=3).orderBy("position").collect()] == ["January", "February", "March"]
    week = profile.weekday_pattern(df, ["m"]).orderBy("position").collect()
    assert len(week) == 7 and week[1].weekday == "Tuesday" and week[1].m is None


def test_statistics_document(spark, series):
    doc = profile.statistics_json(series, ["pm2_5", "pm10"], keys=("station",)).filter("station = 0").first().document
    import json
    parsed = json.loads(doc)
    assert parsed["metadata"]["total_rows"] == 70 and list(parsed["measure_statistics"]) == ["pm2_5", "pm10"]
    assert parsed["measure_statistics"]["pm10"]["median"] == 34.5 and parsed["time_range"]["span_days"] == 2


@pytest.mark.parametrize("share,parsed", [(79, False), (80, False), (81, True)])
def test_a_format_must_read_more_than_four_fifths(spark, share, parsed):
    rows = [(f"0{1 + i % 9}/02/2024 10:30" if i < share else "bad",) for i in range(100)]
    got = schema.parse_datetime(spark.createDataFrame(rows, "t string"), "t")
    assert got.filter("datetime is not null").count() == (share if parsed else 0)


@pytest.mark.parametrize("text,want", [
    ("2024-02-03 04:05:06", "2024-02-03 04:05:06"), ("03/02/2024 04:05", "2024-02-03 04:05:00"),
    ("02/13/2024 04:05", "2024-02-13 04:05:00"), ("2024-02-03", "2024-02-03 00:00:00"),
    ("03-02-2024", "2024-02-03 00:00:00"), ("03/02/2024", "2024-02-03 00:00:00"), ("02/13/2024", "2024-02-13 00:00:00"),
    ("2024-02-03T04:05:06", "2024-02-03 04:05:06")])
def test_formats(spark, text, want):
    got = schema.parse_datetime(spark.createDataFrame([(text,)] * 3, "t string"), "t").first().datetime
    assert str(got) == want


def test_names():
    want = {"PM 2.5": "pm2_5", "pm_25": "pm2_5", "PM2.5 (ug)": "pm2_5", "pm10": "pm10", "NO2_mean": "no2", "SO2": "so2",
            "CO": "co", "co2": None, "Carbon Monoxide": "co", "Ozone": "o3", "O3": "o3", "width": None, "c.o": "co"}
    assert {k: schema.measure_of(k) for k in want} == want
    assert schema.column_named_like_time(["id", "Width", "Date"]) == "Width"
    assert schema.column_named_like_time(["id", "Width", "Date"], ("date", "time")) == "Date"
    assert schema.column_named_like_time(["id"]) is None


def test_validation_rules(spark):
    empty = spark.createDataFrame([], "x int")
    assert [(r.rule, r.ok) for r in schema.validate_upload(empty).collect()] == [("not_empty", False)]
    df = spark.createDataFrame([("a", "b")], "x string, pm2_5 string")
    rules = {r.rule: r.ok for r in schema.validate_upload(df).collect()}
    assert rules == {"not_empty": True, "min_rows": False, "has_datetime": False, "has_measure": True, "numeric_pm2_5": False}


def test_metrics(spark):
    rows = [("perfect", 1.0, 1.0), ("perfect", 2.0, 2.0), ("mean", 1.0, 2.0), ("mean", 3.0, 2.0), ("zero", 0.0, 1.0), ("zero", 2.0, 2.0),
            ("flat", 5.0, 5.0), ("flat", 5.0, 6.0)]
    df = spark.createDataFrame(rows, "measure string, actual double, predicted double")
    m = {r.measure: r for r in scoring.regression_metrics(df).collect()}
    assert m["perfect"].r2 == 1 and m["perfect"].mae == 0 and m["mean"].r2 == 0 and m["mean"].mae == 1
    assert close(m["zero"].mape, 1 / 1e-6 * 100 / 2) and m["flat"].r2 is None
    errors = scoring.prediction_errors(df.filter("measure = 'zero'")).orderBy("actual").collect()
    assert errors[0].error_pct is None and errors[1].error_pct == 0


def test_append_and_align(spark):
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    assert relational.align_features(df, ["a", "c", "b"]).first()[:] == (2.0, 0.0, 1.0)
    more = relational.append_rows(df, spark.createDataFrame([(7,)], "a int"))
    assert sorted(more.select("a").toPandas().a) == [2, 7]


def test_naive_forecast_skips_missing_last_values(spark):
    df = spark.createDataFrame([(0, at(0), 1.0), (0, at(1), None), (1, at(5), 2.0)], "station int, datetime timestamp_ntz, m double")
    got = scoring.naive_forecast(df, HOURS, ["m"], 2).orderBy("datetime").collect()
    assert [(r.station, r.datetime, r.forecast) for r in got] == [(1, at(6), 2.0), (1, at(7), 2.0)]


def test_weekend_compare_without_weekend(spark):
    df = spark.createDataFrame([(at(0), 4.0)], "datetime timestamp_ntz, m double")
    r = profile.weekend_compare(df, ["m"]).first()
    assert r.weekday_mean == 4.0 and r.weekend_mean is None and r.difference_pct is None and not math.isnan(r.weekday_mean)
