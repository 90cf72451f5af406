"""Micro-tables with expectations from pandas or by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skysense.operators import grid, impute, outliers, quantiles, scaling
from skysense.plans import cleaning
from skysense.series import Series
from tests.conftest import at, close

HOURS = Series(chunk=6 * 3600)
GAPS = [(1, 0.0, None), (1, 1.0, 4.0), (1, 2.0, None), (1, 5.0, None), (1, 6.0, 9.0), (1, 6.5, None), (1, 20.0, 2.0),
        (1, 30.0, None), (2, 0.0, None), (2, 3.0, None), (3, 1.0, 5.0)]


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(k, at(h), v) for k, h, v in GAPS]
    return spark.createDataFrame(rows, "station int, datetime timestamp_ntz, m double")


def expected(how):
    pdf = pd.DataFrame([(k, at(h), v) for k, h, v in GAPS], columns=["station", "datetime", "m"])
    out = {}
    for k, g in pdf.groupby("station"):
        filled = how(g.set_index("datetime")["m"].astype(float))
        out.update({(k, t.to_pydatetime()): None if np.isnan(v) else v for t, v in filled.items()})
    return out


def got(df):
    return {(r.station, r.datetime): r.m for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert close(a[k], b[k]), (k, a[k], b[k])


def test_interpolate_time(gaps):
    same(got(impute.interpolate(gaps, HOURS, ["m"])),
         expected(lambda s: s.interpolate(method="time", limit_direction="both")))


def test_interpolate_rows(gaps):
    same(got(impute.interpolate(gaps, HOURS, ["m"], by="row")),
         expected(lambda s: s.interpolate(method="linear", limit_direction="both")))


def test_forward_fill(gaps):
    same(got(impute.forward_fill(gaps, HOURS, ["m"])), expected(lambda s: s.ffill()))
    assert impute.fill_missing(gaps, HOURS, ["m"], "forward_fill").count() == 8


def test_impute_smart_takes_the_median_above_half_missing(spark, gaps):
    # Series 1 misses 5 of 8 values, so its median 4 fills; 2 has none; 3 misses nothing.
    filled = got(impute.impute_smart(gaps, HOURS, ["m"]))
    assert filled[(1, at(0))] == 4.0 and filled[(1, at(5))] == 4.0 and filled[(1, at(6))] == 9.0
    assert filled[(2, at(0))] is None and filled[(3, at(1))] == 5.0
    half = spark.createDataFrame([(1, at(i), v) for i, v in enumerate([1.0, None, 3.0, None])],
                                 "station int, datetime timestamp_ntz, m double")
    assert [r.m for r in impute.impute_smart(half, HOURS, ["m"]).orderBy("datetime").collect()] == [1.0, 2.0, 3.0, 3.0]


def test_regularize_drops_off_grid_rows(spark):
    rows = [(1, at(1 / 3), 1.0), (1, at(4 / 3), None), (1, at(2), 50.0), (1, at(10 / 3), 4.0), (1, at(13 / 3), None)]
    df = spark.createDataFrame(rows, "station int, datetime timestamp_ntz, m double")
    out = [(r.datetime.minute, r.m) for r in grid.regularize(df, HOURS, ["m"]).orderBy("datetime").collect()]
    assert [m for m, _ in out] == [20] * 5
    for (_, v), want in zip(out, [1.0, 2.0, 3.0, 4.0, 4.0]):
        assert close(v, want)


def test_regularize_keeps_leading_gaps(spark):
    rows = [(1, at(0), None), (1, at(1), 2.0), (1, at(3), 4.0)]
    df = spark.createDataFrame(rows, "station int, datetime timestamp_ntz, m double")
    assert [r.m for r in grid.regularize(df, HOURS, ["m"]).orderBy("datetime").collect()] == [None, 2.0, 3.0, 4.0]


def test_long_spine(spark):
    df = spark.createDataFrame([(1, at(0), 1.0), (1, at(5000), 2.0)], "station int, datetime timestamp_ntz, m double")
    spine = grid.time_spine(df, HOURS)
    assert spine.count() == 5001 and spine.distinct().count() == 5001


def test_resample_has_rows_for_empty_bins(spark):
    df = spark.createDataFrame([(1, at(1), 1.0), (1, at(2), 3.0), (1, at(20), 5.0)],
                               "station int, datetime timestamp_ntz, m double")
    out = grid.resample_mean(df, HOURS, ["m"], 6 * 3600).orderBy("datetime").collect()
    assert [(r.datetime, r.m) for r in out] == [(at(0), 2.0), (at(6), None), (at(12), None), (at(18), 5.0)]
    assert grid.resample_mean(df, HOURS, ["m"], 3600) is df


def test_dedupe_keeps_the_first(spark):
    df = spark.createDataFrame([(1, at(0), 3, 9.0), (1, at(0), 1, None), (1, at(0), 2, 7.0), (1, at(1), 4, 1.0)],
                               "station int, datetime timestamp_ntz, seq int, m double")
    kept = {r.datetime: (r.seq, r.m) for r in grid.dedupe_first(df, HOURS, "seq").collect()}
    assert kept == {at(0): (1, None), at(1): (4, 1.0)}
    assert kept == {r.datetime: (r.seq, r.m) for r in grid.dedupe_first(df, HOURS, ["seq", "datetime"]).collect()}


def test_quantiles(spark):
    """Groups of 1 to 100,000 rows in one call: ties, heavy ties, tiny and huge and negative values, neighbours in the last bit."""
    rng = np.random.default_rng(5)
    near = np.nextafter(1.7e9, np.inf)
    groups = {
        0: rng.normal(0, 1, 100_000), 1: np.array([3.5]), 2: np.array([2.0, -2.0]), 3: np.repeat([1.0, 2.0, 7.0], [5, 4000, 1]),
        4: 1.7e9 + rng.integers(0, 50, 3000).astype(float), 5: np.array([1.7e9, near, 1.7e9, near, np.nextafter(near, np.inf)]),
        6: np.concatenate([[0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1e308, -1e308, 1.7976931348623157e308], 2.0 ** np.arange(-1074, 1024, 7.0)]),
        7: np.round(rng.lognormal(2, 3, 2000), 1)}
    frame = pd.DataFrame([(k, v) for k, vs in groups.items() for v in vs], columns=["station", "m"])
    df = spark.createDataFrame(frame).repartition(3).unionByName(spark.createDataFrame([(1, None), (8, None)], "station long, m double"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    found = {r.station: (r.n, r.q) for r in quantiles.quantiles(df, ["m"], probs, ("station",)).collect()}
    assert set(found) == set(groups)
    for k, vs in groups.items():
        assert found[k][0] == len(vs)
        for got, want in zip(found[k][1], np.quantile(vs, probs)):
            assert close(got, want, 1e-12), k
    # The same as the built-in where that holds all values of a group.
    built_in = df.groupBy("station").agg(F.percentile("m", F.array(*[F.lit(p) for p in probs])).alias("q")).filter("station < 6").collect()
    assert all(close(a, b, 1e-12) for r in built_in for a, b in zip(r.q, found[r.station][1]))


def test_leading_bits_order_as_values_do(spark):
    rng = np.random.default_rng(6)
    powers = np.concatenate([2.0 ** np.arange(-1074, 1024), 2.0 ** np.arange(-1000, 1000) * (1 - 2.0**-53)])
    values = np.unique(np.concatenate([powers, rng.random(2000), rng.lognormal(0, 200, 2000), [0.0, np.inf]]))
    values = np.concatenate([-values[::-1], values])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")
    bits = [r.b for r in df.select("i", quantiles.leading_bits(F.col("v")).alias("b")).orderBy("i").collect()]
    assert all(a <= b for a, b in zip(bits, bits[1:]))
    # Powers of two and their neighbours below fall into different buckets.
    by_value = dict(zip(values, bits))
    assert all(by_value[2.0**e] > by_value[2.0**e * (1 - 2.0**-53)] for e in range(-1000, 1000))


def test_quantiles_without_keys_or_rows(spark):
    empty = spark.createDataFrame([], "station int, m double")
    assert quantiles.quantiles(empty, ["m"], [0.5]).count() == 0
    df = spark.createDataFrame([(1, 1.0), (2, 4.0)], "station int, m double")
    assert quantiles.quantiles(df, ["m"], [0.5]).first().q == [2.5]


def test_sketched_quantiles_stay_within_their_rank_error(spark):
    from skysense.operators import profile

    values = np.random.default_rng(1).permutation(20_000).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "m double").repartition(5)
    for r in profile.percentiles(df, ["m"], exact=False).collect():
        assert abs(r.value - r.percentile / 100 * 20_000) <= 20_000 / quantiles.ACCURACY + 1
    assert profile.describe(df, ["m"], exact=False).first().median in (9998.0, 9999.0, 10000.0, 10001.0)


@pytest.mark.parametrize("seed", range(3))
def test_filling_leaves_no_hole_between_valid_values(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(k, at(float(h)), None if rng.random() < 0.7 else float(rng.uniform(0, 9)))
            for k in range(3) for h in np.cumsum(rng.integers(1, 9, 60))]
    df = spark.createDataFrame(rows, "station int, datetime timestamp_ntz, m double")
    filled = impute.interpolate(df, HOURS, ["m"])
    assert filled.filter("m is null").count() == 0 and filled.count() == len(rows)
    low, high = df.agg(F.min("m"), F.max("m")).first()
    assert filled.filter((F.col("m") < low - 1e-9) | (F.col("m") > high + 1e-9)).count() == 0


def test_capping_twice_with_the_same_fences_changes_nothing(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 90, -70]], "m double")
    limits = outliers.fences(df, ["m"], k=1.5).cache()
    once = outliers.cap_outliers(df, ["m"], limits=limits)
    twice = outliers.cap_outliers(once, ["m"], limits=limits)
    assert sorted(r.m for r in once.collect()) == sorted(r.m for r in twice.collect()) != sorted(r.m for r in df.collect())


def test_capping(spark):
    values = [1.0, 2.0, 3.0, 4.0, 1000.0, None]
    df = spark.createDataFrame([(0, v) for v in values] + [(1, 7.0), (1, 7.0)], "station int, m double")
    pdf = pd.Series(values[:5])
    q1, q3 = pdf.quantile(0.25), pdf.quantile(0.75)
    capped = outliers.cap_outliers(df, ["m"], ("station",))
    assert sorted((r.m for r in capped.filter("station = 0 and m is not null").collect())) == [1, 2, 3, 4, q3 + 3 * (q3 - q1)]
    assert capped.filter("station = 0 and m is null").count() == 1
    assert [r.m for r in capped.filter("station = 1").collect()] == [7.0, 7.0]
    counts = {r.station: r.outliers for r in outliers.count_outliers(df, ["m"], ("station",)).collect()}
    assert counts == {0: 1, 1: 0}
    z = outliers.cap_outliers(df, ["m"], ("station",), method="zscore", k=1.0)
    assert close(max(r.m for r in z.filter("station = 0 and m is not null").collect()), pdf.mean() + pdf.std())


def test_fences_from_training_rows_only(spark):
    df = spark.createDataFrame([(float(i), "train") for i in range(9)] + [(500.0, "test")], "m double, part string")
    capped = outliers.cap_outliers(df, ["m"], k=1.0, fit_on=F.col("part") == "train")
    assert max(r.m for r in capped.collect()) == 10.0


def test_scaling_round_trip(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (0, 8.0), (1, 2.0), (1, 2.0)], "station int, m double")
    for method in ("minmax", "standard"):
        params = scaling.scaler_params(df, ["m"], ("station",), method=method)
        scaled = scaling.normalize(df, params, ["m"], ("station",))
        assert scaled.filter("station = 1 and m is not null").count() == 0
        back = scaling.inverse_normalize(scaled, params, ["m"], ("station",)).filter("station = 0")
        for a, b in zip(sorted(r.m for r in back.collect()), [1.0, 3.0, 8.0]):
            assert close(a, b)


def test_clean_options(spark):
    rows = [("2024-01-01 00:00:00", 0, 1, 5.0), ("2024-01-01 02:00:00", 0, 2, None), ("2024-01-01 03:00:00", 0, 3, 8.0),
            ("2024-01-01 03:00:00", 0, 4, 9.0)]
    df = spark.createDataFrame(rows, "time string, station int, seq int, `PM 2.5` double")
    done = cleaning.clean(df, HOURS, "seq", missing="interpolate", outlier=None)
    assert [r.pm2_5 for r in done.data.orderBy("datetime").collect()] == [5.0, 6.0, 7.0, 8.0]
    log = {r.action: r.n for r in done.log.filter("step <> 5").collect()}
    assert log["parse_datetime"] == 4 and log["dedupe"] == 3 and log["regularize"] == 4
    coarse = cleaning.clean(df, HOURS, "seq", missing="forward_fill", step=None, outlier="zscore")
    assert [r.pm2_5 for r in coarse.data.orderBy("datetime").collect()] == [5.0, 5.0, 8.0]


def test_prepare_training_fits_on_train(spark):
    rows = [(0, at(i), float(i % 7) if i < 80 else 100.0) for i in range(100)]
    df = spark.createDataFrame(rows, "station int, datetime timestamp_ntz, m double")
    done = cleaning.prepare_training(df, HOURS, ["m"], fit_on_train=True)
    assert done.data.filter("split = 'train'").agg(F.min("m"), F.max("m")).first()[:] == (0.0, 1.0)
    assert done.data.filter("split = 'test'").agg(F.max("m")).first()[0] > 1.0


def test_cadence_of_many_different_gaps(spark):
    """No window runs over a series' gap lengths, only over folded values within a bucket of leading bits."""
    hours = np.concatenate([[0], np.cumsum(np.random.default_rng(4).permutation(np.arange(1, 1501)))])
    rows = [(k, at(float(h) / 3600)) for k in (1, 3) for h in hours] + [(2, at(0))]
    df = spark.createDataFrame(rows, "station int, datetime timestamp_ntz")
    lengths = np.diff(hours)
    want = (len(lengths), int(lengths.min()), int(lengths.max()), float(np.median(lengths)))
    whole = grid.cadence_profile(df, HOURS)
    windows = [line for line in whole._jdf.queryExecution().executedPlan().toString().splitlines() if "- Window" in line]
    assert windows and all("_bits" in line.split("specifiedwindowframe")[0] for line in windows)
    assert {r[0]: tuple(r)[1:] for r in whole.collect()} == {1: want, 3: want, 2: (0, None, None, None)}
    one = grid.cadence_profile(df.filter("station = 1"), Series(keys=(), chunk=6 * 3600))
    assert [tuple(r) for r in one.collect()] == [want]
    alone = grid.cadence_profile(df.filter("station = 2"), Series(keys=(), chunk=6 * 3600))
    assert [tuple(r) for r in alone.collect()] == [(0, None, None, None)]


def test_checked_scan_keeps_what_it_cannot_read(spark, tmp_path):
    """Bad cells, lines too long and too short, empty cells, NaN and an unreadable time; none is lost."""
    from skysense.operators import schema
    from skysense.sources import readings

    (tmp_path / "r.csv").write_text("station,datetime,pm10\n1,2024-01-01 00:00:00,5.5\n1,2024-01-01 01:00:00,n/a\nx,soon,\n"
                                    "2,2024-01-01 02:00:00,7,8\n3\n4,2024-01-01 03:00:00,NaN\n")
    checked = readings.scan_checked(spark, str(tmp_path), "station long, datetime timestamp_ntz, pm10 double")
    rows = checked.rows.collect()
    assert checked.counts.get == {"rows": 6, "bad_lines": 2, "bad_cells": 3}
    assert sorted((r.station or 0, r.pm10 or 0.0) for r in rows) == [(0, 0.0), (1, 0.0), (1, 5.5), (2, 7.0), (3, 0.0), (4, 0.0)]
    assert sorted((r.reason, r.column or "", r.found) for r in checked.problems.collect()) == [
        ("cell", "datetime", "soon"), ("cell", "pm10", "n/a"), ("cell", "station", "x"),
        ("line", "", "2,2024-01-01 02:00:00,7,8"), ("line", "", "3")]
    # Reading one column only sees the same lines.
    assert checked.data.select("pm10").count() == 6
    rules = {r.rule: (r.ok, r.detail) for r in schema.validate_upload(checked.rows, ["pm10"], 1, problems="problems").collect()}
    assert rules["readable_lines"] == (False, "2") and rules["readable_pm10"] == (False, "1") and rules["min_rows"] == (True, "6")


def test_checked_scan_refuses_another_header(spark, tmp_path):
    from skysense.sources import readings

    (tmp_path / "r.csv").write_text("datetime,station\n2024-01-01 00:00:00,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        readings.scan_checked(spark, str(tmp_path), "station long, datetime timestamp_ntz").rows.collect()
    with pytest.raises(ValueError, match="problems"):
        readings.scan_checked(spark, str(tmp_path), "problems long")
