"""Cut-up computation must equal the plain window over the whole series."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skysense.operators import features, impute, scaling
from skysense.series import Series, along_rows, neighbours, number_rows
from skysense.session import attach, materialize
from tests.conftest import at

SCHEMA = "station int, datetime timestamp_ntz, seq int, m double"


@pytest.fixture(scope="module")
def uneven(spark):
    """Three series; the first holds most rows. Uneven spacing, gaps, runs of NULL at both ends."""
    rng, rows = random.Random(7), []
    for station, n in ((0, 400), (1, 60), (2, 1)):
        t = 0.0
        for i in range(n):
            t += rng.choice([0.25, 1, 1, 1, 5, 30])
            value = None if i < 5 or i >= n - 4 or rng.random() < 0.5 else round(rng.uniform(0, 100), 2)
            rows.append((station, at(t), i, value))
    rows += [(3, at(i), i, None) for i in range(10)]
    rng.shuffle(rows)
    return materialize(spark.createDataFrame(rows, SCHEMA))


SERIES = [Series(chunk=24 * 3600, block=32), Series(chunk=3 * 3600, block=64), Series(chunk=None, block=50),
          Series(chunk=10_000_000)]


def rows(df):
    return sorted(df.collect(), key=repr)


@pytest.mark.parametrize("s", SERIES, ids=str)
def test_positions(uneven, s):
    w = Window.partitionBy("station").orderBy("datetime")
    plain = uneven.select("station", "datetime", (F.row_number().over(w) - 1).cast("long").alias("p"),
                          F.count("*").over(Window.partitionBy("station")).alias("n"))
    cut = number_rows(uneven, s, "p", total="n").select("station", "datetime", "p", "n")
    assert rows(cut) == rows(plain)


@pytest.mark.parametrize("s", SERIES, ids=str)
def test_lags_and_rolling(uneven, s):
    def exprs(w):
        return [F.lag("m", 7).over(w).alias("l"), F.lead("m", 3).over(w).alias("f"),
                F.count("m").over(w.rowsBetween(-11, 0)).alias("c"), F.max("m").over(w.rowsBetween(-11, 2)).alias("x")]
    plain = uneven.select("*", *exprs(Window.partitionBy("station").orderBy("datetime")))
    cut = along_rows(uneven, s, exprs, before=11, after=3).select(*plain.columns)
    assert rows(cut) == rows(plain)


@pytest.mark.parametrize("by", ["time", "row"])
@pytest.mark.parametrize("s", SERIES, ids=str)
def test_neighbours(uneven, s, by):
    one = neighbours(uneven, Series(chunk=100_000_000), ["m"], by=by)
    cut = neighbours(uneven, s, ["m"], by=by)
    assert rows(cut) == rows(one)


def test_neighbours_with_repeated_times(spark):
    data = [(0, at(0), 1, 1.0), (0, at(1), 2, 2.0), (0, at(1), 3, 3.0), (0, at(1), 4, None), (0, at(30), 5, None),
            (0, at(60), 6, 7.0), (0, at(60), 7, 8.0)]
    df = materialize(spark.createDataFrame(data, SCHEMA))
    for chunk in (3600, 24 * 3600, None):
        s = Series(tiebreak=("seq",), chunk=chunk)
        got = {r.seq: r for r in neighbours(df, s, ["m"]).collect()}
        assert got[4]["_prev_m"].v == 3.0 and got[5]["_prev_m"].v == 3.0
        assert got[4]["_next_m"].v == 7.0 and got[5]["_next_m"].v == 7.0


def test_keyed_equals_union_of_single_series(uneven):
    s = Series(chunk=24 * 3600)
    keyed = impute.interpolate(uneven, s, ["m"])
    parts = None
    for k in range(4):
        one = impute.interpolate(uneven.filter(F.col("station") == k), Series(keys=(), chunk=24 * 3600), ["m"])
        parts = one if parts is None else parts.unionByName(one)
    assert rows(keyed) == rows(parts)


def test_no_keys_orders_by_tiebreak(uneven):
    s = Series(chunk=24 * 3600).over_all()
    pos = number_rows(uneven, s, "p").orderBy("p").collect()
    assert [r.p for r in pos] == list(range(471))
    assert [(r.datetime, r.station) for r in pos] == sorted((r.datetime, r.station) for r in pos)


def test_partitioning_does_not_matter(uneven):
    s = Series(chunk=24 * 3600, block=40)
    a = features.rolling_features(uneven, s, ["m"], (3,))
    b = features.rolling_features(uneven.repartition(13), s, ["m"], (3,))
    assert rows(a) == rows(b)


def test_attach_beyond_the_broadcast_limit(spark, uneven):
    params = uneven.groupBy("station").agg(F.max("m").alias("top"))
    near = attach(uneven, params, ("station",))
    far = attach(uneven, params, ("station",), max_bytes=0)
    assert rows(near) == rows(far.select(*near.columns))
    far.collect()
    assert far.count() == uneven.count()


def test_split_sizes(spark):
    for n, want in ((0, (0, 0, 0)), (1, (0, 0, 1)), (7, (4, 1, 2)), (10, (7, 1, 2)), (17521, (12264, 1752, 3505))):
        df = spark.range(n).select(F.lit(0).alias("station"), F.col("id").alias("datetime"))
        s = Series(chunk=1000)
        got = dict(scaling.split_time(df, s).groupBy("split").count().collect())
        assert tuple(got.get(k, 0) for k in ("train", "val", "test")) == want
