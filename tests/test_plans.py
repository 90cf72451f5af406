"""Properties of physical plans that decide whether an operator scales."""

import re

import pytest
from pyspark.sql import functions as F

from skysense.operators import features, grid, impute, profile, relational
from skysense.queries import QUERIES
from skysense.queries.common import HOURS, MS
from skysense.session import materialize
from skysense.sources import readings


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hours(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield materialize(readings.hourly(spark, sf))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_windows_never_gather_a_series(hours):
    for df in (impute.interpolate(hours, HOURS, MS), impute.forward_fill(hours, HOURS, MS),
               impute.interpolate(hours, HOURS, MS, by="row"), features.rolling_features(hours, HOURS, ["pm2_5"]),
               features.supervised_features(hours, HOURS, "pm2_5"), grid.gaps(hours, HOURS),
               features.half_trend(hours, HOURS, "pm2_5")):
        text = plan(df)
        assert "SinglePartition" not in text and "Python" not in text
        # A window by station alone may only run over the one-row-per-chunk summary.
        for line in text.splitlines():
            by_station = re.search(r"Window \[.*windowspecdefinition\(station#\d+L?, ([^#]*)#?", line)
            if by_station and not by_station.group(1).startswith(("_chunk", "_block")):
                assert "_rows" in line, line
        assert re.search(r"Exchange hashpartitioning\(station#\d+L?, (_chunk|_block)", text)


def test_one_sort_for_all_features(hours):
    text = plan(features.supervised_features(hours, HOURS, "pm2_5", step=3600))
    assert len(re.findall(r"Sort \[", text)) == 1 and len(re.findall(r"Window \[", text)) == 1
    assert len(re.findall(r"Exchange hash", text)) == 1


def test_top_rows_are_limited_before_the_shuffle(hours):
    assert "Partial" in plan(relational.tail_n(hours, HOURS, 5)) and "WindowGroupLimit" in plan(relational.tail_n(hours, HOURS, 5))


def test_first_and_last_are_hash_aggregations(spark, sf, hours):
    assert "SortAggregate" not in plan(relational.latest_reading(hours, HOURS))
    assert "SortAggregate" not in plan(grid.dedupe_first(readings.event_rows(spark, sf), HOURS, "event_id"))
    assert "SortAggregate" not in plan(impute.interpolate(hours, HOURS, ["pm2_5"]))


def test_scans_are_pruned_and_filtered(spark, sf):
    text = plan(readings.hourly(spark, sf).select("station", "datetime", "pm2_5"))
    assert "props" not in text and "event_id" not in text and "PushedFilters: [IsNotNull(ts)]" in text
    li = plan(readings.daily(spark, sf).filter(F.col("station") == 3))
    assert "EqualTo(l_suppkey,3)" in li and "l_comment" not in li


def test_profiles_aggregate_in_one_pass(hours):
    for df in (profile.corr_matrix(hours, MS, ("station",)), profile.missing_profile(hours, MS, ("station",)),
               profile.hourly_pattern(hours, MS, keys=("station",)), profile.skewness(hours, MS, ("station",))):
        assert plan(df).count("FileScan") == 1


@pytest.mark.parametrize("name", ["aqi_events", "time_features", "hourly_pattern", "dedupe_first"])
def test_no_python_in_the_hot_path(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "Python" not in text and "Pandas" not in text
