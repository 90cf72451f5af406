"""Training, store and forecasts with few trees on an autocorrelated series."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from skysense.forecasting.models import (
    BoostingParams, ModelStore, Trained, feature_importance, learning_curve, learning_curves, predict_all, predict_measure,
    train_all, train_measure,
)
from skysense.forecasting.recursive import forecast_all, forecast_recursive
from skysense.operators.features import features_of, supervised_features, wide_features
from skysense.operators.scaling import split_time
from skysense.series import Series
from skysense.session import materialize, new_path
from tests.conftest import at, close

HOURS = Series(chunk=48 * 3600)
FEW = BoostingParams(trees=3, depth=3, lookback=6)


@pytest.fixture(scope="module")
def waves(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in (0, 1):
        for i in range(300):
            wave = 50 + 30 * math.sin(2 * math.pi * i / 24) + rng.normal(0, 1)
            rows.append((k, at(i), float(wave), float(100 - wave + rng.normal(0, 1))))
    return materialize(spark.createDataFrame(rows, "station int, datetime timestamp_ntz, pm2_5 double, pm10 double"))


@pytest.fixture(scope="module")
def split(waves):
    return materialize(split_time(waves, HOURS))


@pytest.fixture(scope="module")
def trained(split):
    return train_measure(split, HOURS, "pm2_5", FEW)


def test_better_than_the_mean(trained):
    m = trained.metrics.first()
    assert m.samples == 2 * (60 - 6) and m.r2 > 0.5 and m.rmse > 0


def test_importances_sum_to_one(trained):
    table = feature_importance(trained).collect()
    assert len(table) == len(trained.features) and close(sum(r.importance for r in table), 1.0, 1e-6)
    assert [r.importance for r in table] == sorted((r.importance for r in table), reverse=True)


def test_store_round_trip(spark, waves, trained):
    store = ModelStore(spark, new_path(spark, "store"))
    store.save(trained)
    assert {r.measure: r.has_model for r in store.presence(["pm2_5", "pm10"]).collect()} == {"pm2_5": True, "pm10": False}
    back = store.load("pm2_5")
    assert back.features == trained.features and back.metrics.first().r2 == trained.metrics.first().r2
    a = predict_measure(waves, HOURS, trained, lookback=6).orderBy("station", "datetime").collect()
    b = predict_measure(waves, HOURS, back, lookback=6).orderBy("station", "datetime").collect()
    assert a == b and len(a) == 2 * (300 - 6)


def test_a_save_that_is_cut_off_leaves_the_version_before(spark, trained, monkeypatch):
    store = ModelStore(spark, new_path(spark, "store"))
    store.save(trained)
    changed = Trained(trained.measure, trained.model, [*trained.features[1:], "later"], trained.metrics)
    with monkeypatch.context() as broken:
        broken.setattr(ModelStore, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            store.save(changed)
    assert store.load("pm2_5").features == trained.features and len(store.versions("pm2_5")) == 1
    store.save(changed)
    assert store.load("pm2_5").features == changed.features
    assert [n for n, _ in store.versions("pm2_5")] == [1, 2]
    with pytest.raises(ValueError, match="no model of pm10"):
        store.load("pm10")


def test_learning_curve_equals_the_errors_of_shorter_models(split, trained):
    """The error after k trees is that of the model of the first k trees, and the last is the model's own."""
    curve = {(r.part, r.trees): r for r in learning_curve(split, HOURS, trained, lookback=6).collect()}
    assert sorted({p for p, _ in curve}) == ["test", "train", "val"] and len(curve) == 3 * trained.trees == 9
    assert [curve[p, 1].samples for p in ("train", "val", "test")] == [2 * (210 - 6), 2 * (30 - 6), 2 * (60 - 6)]
    rows = supervised_features(split, HOURS.within("split"), "pm2_5", lookback=6)
    ready = trained.model.stages[0].transform(rows).select("split", "features", "pm2_5").collect()
    boosted = trained.model.stages[-1]
    for (part, k), r in curve.items():
        squares = [(sum(w * t.predict(x.features) for t, w in zip(boosted.trees[:k], boosted.treeWeights)) - x.pm2_5) ** 2
                   for x in ready if x.split == part]
        assert close(r.rmse, math.sqrt(sum(squares) / len(squares)), 1e-9)
    assert close(curve["test", 3].rmse, trained.metrics.first().rmse, 1e-9)
    both = learning_curves(split, HOURS, {"pm2_5": trained}, lookback=6)
    assert sorted(both.collect()) == sorted(curve.values())


def test_validation_rows_decide_on_the_number_of_trees(spark, split):
    """A validation part that has nothing to do with the training part stops at once; without early stopping it doesn't matter."""
    odd = split.withColumn("pm2_5", F.when(F.col("split") == "val", 1000 - 10 * F.col("pm2_5")).otherwise(F.col("pm2_5")))
    params = {"trees": 12, "depth": 3, "lookback": 6, "step": 0.5}
    free, stopped = BoostingParams(**params), BoostingParams(**params, early_stop=True)
    assert train_measure(odd, HOURS, "pm2_5", free).trees == 12
    short = train_measure(odd, HOURS, "pm2_5", stopped)
    assert 1 <= short.trees < 12 and short.metrics.first().samples == 2 * (60 - 6)
    curve = {r.trees: r.rmse for r in learning_curve(odd, HOURS, short, lookback=6).filter("part = 'val'").collect()}
    assert min(curve, key=curve.get) == short.trees
    with pytest.raises(ValueError, match="no validation row"):
        train_measure(odd.filter("split != 'val'"), HOURS, "pm2_5", stopped)


def test_curves_need_boosted_trees(split, trained):
    flat = Trained("pm2_5", PipelineModel([trained.model.stages[0]]), trained.features, None)
    with pytest.raises(ValueError, match="isn't boosted"):
        learning_curve(split, HOURS, flat, lookback=6)


def test_failures_are_reported_per_measure(split):
    broken = split.withColumn("pm10", F.lit(None).cast("double"))
    models, table = train_all(broken.select("station", "datetime", "pm10", "split"), HOURS, ["pm10"], FEW)
    assert not models and table.first().status.startswith("failed")
    models, table = train_all(split, HOURS, ["pm2_5", "pm10"], FEW)
    assert {r.measure: r.status for r in table.collect()} == {"pm2_5": "ok", "pm10": "ok"}
    both = predict_all(split.drop("split"), HOURS, models, lookback=6)
    assert both.select("measure").distinct().count() == 2


def brute_force(spark, trained, frame, hours):
    """One series, one hour at a time, with pandas features."""
    m, ctx, out = "pm2_5", frame.tail(12).copy(), []
    for _ in range(hours):
        row = {"pm10": ctx.pm10.iloc[-1]}
        for k in range(1, 7):
            row[f"{m}_lag_{k}"] = ctx[m].shift(k).iloc[-1]
        for w in (3, 6):
            row[f"{m}_rolling_mean_{w}"] = ctx[m].rolling(w).mean().iloc[-1]
            row[f"{m}_rolling_std_{w}"] = ctx[m].rolling(w).std().iloc[-1]
        t = ctx.index[-1]
        for name, value, period in (("hour", t.hour, 24), ("dow", t.dayofweek, 7), ("month", t.month, 12)):
            row[f"{name}_sin"], row[f"{name}_cos"] = math.sin(2 * math.pi * value / period), math.cos(2 * math.pi * value / period)
        row.update(hour=t.hour, day_of_week=t.dayofweek, month=t.month, is_weekend=int(t.dayofweek >= 5), season=(t.month % 12 + 3) // 3)
        df = spark.createDataFrame([tuple(float(row[f]) for f in trained.features)], trained.features)
        predicted = trained.model.transform(df).first().predicted
        t = t + pd.Timedelta(hours=1)
        out.append((t.to_pydatetime(), predicted))
        ctx.loc[t] = {m: predicted, "pm10": ctx.pm10.iloc[-1]}
    return out


def test_forecast_equals_a_loop(spark, waves, trained):
    ahead = forecast_recursive(waves, HOURS, trained, 10, lookback=6)
    assert ahead.count() == 20
    got = [(r.datetime, r.forecast) for r in ahead.filter("station = 1").orderBy("step").collect()]
    frame = waves.filter("station = 1").orderBy("datetime").toPandas().set_index("datetime")[["pm2_5", "pm10"]]
    want = brute_force(spark, trained, frame, 10)
    assert [t for t, _ in got] == [t for t, _ in want]
    for (_, a), (_, b) in zip(got, want):
        assert close(a, b, 1e-6)
    early = forecast_recursive(waves, HOURS, trained, 2, lookback=6, aligned=True).agg(F.min("datetime")).first()[0]
    assert early == at(299)


def test_walking_trees_equals_the_model_step_by_step(spark, waves, trained, split):
    """All kinds of tree models, with a gap that makes the row to predict from stay behind."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor

    from skysense.forecasting.trees import forest_of

    rows = supervised_features(waves, HOURS, "pm2_5", lookback=6).withColumn("label", F.col("pm2_5"))
    assembler = VectorAssembler(inputCols=trained.features, outputCol="features")
    models = [trained.model, *[Pipeline(stages=[assembler, r]).fit(rows) for r in (
        RandomForestRegressor(numTrees=4, maxDepth=4, predictionCol="predicted", seed=1),
        DecisionTreeRegressor(maxDepth=0, predictionCol="predicted"), DecisionTreeRegressor(maxDepth=6, predictionCol="predicted"))]]
    for model in models:
        t = Trained("pm2_5", model, trained.features, None)
        assert len(forest_of(model).roots) == len(getattr(model.stages[-1], "treeWeights", [1]))
        for df in (waves, hole(waves, 297, "pm2_5"), hole(waves, 299, "pm10")):
            got, want = ([(r.station, r.step, r.datetime, r.forecast) for r in forecast_recursive(
                df, HOURS, t, 9, lookback=6, walk=walk).orderBy("station", "step").collect()] for walk in (True, False))
            assert len(got) == 18 and all(g[:3] == w[:3] and close(g[3], w[3], 1e-9) for g, w in zip(got, want))
    assert forest_of(PipelineModel([SQLTransformer(statement="SELECT *, 1 AS predicted FROM __THIS__")])) is None


def test_a_day_ahead_stores_two_tables(waves, trained, monkeypatch):
    from skysense.forecasting import recursive

    stored = []
    monkeypatch.setattr(recursive, "materialize", lambda df: stored.append(1) or materialize(df))
    other = Trained("pm10", trained.model, [n.replace("pm2_5", "pm10") if n != "pm10" else "pm2_5" for n in trained.features], None)
    rows = forecast_all(waves, HOURS, {"pm2_5": trained, "pm10": other}, 24, lookback=6)
    assert len(stored) == 2 and rows.count() == 2 * 2 * 24


def test_short_series_have_a_reason(waves, trained):
    few = waves.filter(F.col("datetime") < F.lit(at(6)).cast("timestamp_ntz"))
    rows = forecast_recursive(few, HOURS, trained, 1, lookback=6).collect()
    assert len(rows) == 2 and all(r.reason and r.forecast is None for r in rows)
    with pytest.raises(ValueError):
        forecast_recursive(waves, HOURS, trained, 0)


def hole(df, hour, column):
    gone = (F.col("station") == 1) & (F.col("datetime") == F.lit(at(hour)).cast("timestamp_ntz"))
    return df.withColumn(column, F.when(~gone, F.col(column)))


def test_a_gap_doesnt_end_the_forecast(waves, trained):
    """Ten hours back: the last six rows are full, so nothing changes. Two hours back: the row
    before the gap is the last full one until enough predictions follow."""
    plain = forecast_recursive(waves, HOURS, trained, 3, lookback=6).filter("station = 1").orderBy("step").collect()
    far = forecast_recursive(hole(waves, 290, "pm2_5"), HOURS, trained, 3, lookback=6).filter("station = 1").orderBy("step").collect()
    assert [r.forecast for r in far] == [r.forecast for r in plain]
    near = forecast_recursive(hole(waves, 297, "pm2_5"), HOURS, trained, 7, lookback=6).filter("station = 1").orderBy("step").collect()
    before = waves.filter(F.col("datetime") <= F.lit(at(296)).cast("timestamp_ntz"))
    first = forecast_recursive(before, HOURS, trained, 1, lookback=6).filter("station = 1").first().forecast
    assert [r.forecast for r in near[:4]] == [first] * 4 and near[0].datetime == at(300) and near[6].forecast != first


def test_a_measure_that_is_missing_stops_nobody(waves, trained):
    gone = waves.withColumn("pm10", F.when(F.col("station") == 0, F.col("pm10")))
    rows = forecast_recursive(gone, HOURS, trained, 2, lookback=6).collect()
    assert [(r.station, r.reason is None) for r in sorted(rows, key=lambda r: (r.station, r.step or 0))] == [(0, True), (0, True), (1, False)]


def test_long_forecasts(waves, trained):
    fixed = Trained("pm2_5", PipelineModel([SQLTransformer(statement="SELECT *, 0.9 * pm2_5_lag_1 + 1 AS predicted FROM __THIS__")]), trained.features, None)
    rows = forecast_recursive(waves, HOURS, fixed, 170, lookback=6).filter("station = 0").orderBy("step").collect()
    values = [r.pm2_5 for r in waves.filter("station = 0").orderBy("datetime").collect()]
    for r in rows:
        values.append(0.9 * values[-2] + 1)
        assert close(r.forecast, values[-1], 1e-9)
    assert len(rows) == 170


def test_all_measures_are_forecast_and_one_may_fail(waves, trained):
    broken = Trained("pm10", PipelineModel([SQLTransformer(statement="SELECT *, raise_error('broken') AS predicted FROM __THIS__")]),
                     [n.replace("pm2_5", "pm10") if n != "pm10" else "pm2_5" for n in trained.features], None)
    rows = forecast_all(waves, HOURS, {"pm2_5": trained, "pm10": broken}, 2, lookback=6).collect()
    assert sorted((r.measure, r.reason is None) for r in rows) == [("pm10", False), *[("pm2_5", True)] * 4]


def test_one_numbering_for_all_measures(waves, trained):
    text = wide_features(waves, HOURS, ["pm2_5", "pm10"], lookback=6)._jdf.queryExecution().executedPlan().toString()
    assert text.count("row_number()") <= 2 and text.count("FileScan") == 2
    one = features_of(wide_features(waves, HOURS, ["pm2_5", "pm10"], lookback=6), waves, HOURS, "pm10", 6)
    other = supervised_features(waves, HOURS, "pm10", lookback=6)
    assert one.columns == other.columns and sorted(one.collect()) == sorted(other.collect())


def test_lost_tasks_are_no_reason(spark, waves, trained):
    """Only errors of a measure's values or model become its row; with ``strict`` not even those."""
    from py4j.protocol import Py4JJavaError

    jvm = spark.sparkContext._jvm

    class Raising:
        def __init__(self, error):
            self.error = error

        def transform(self, df):
            raise Py4JJavaError("An error occurred", self.error)

    def forecasts_with(error, **options):
        return forecast_all(waves, HOURS, {"pm2_5": Trained("pm2_5", Raising(error), trained.features, None)}, 1, lookback=6, **options)

    aborted = "Job aborted due to stage failure: ExecutorLostFailure"
    own = jvm.org.apache.spark.SparkException(aborted, jvm.java.lang.ArithmeticException("of the values"))
    assert [r.reason.split(":")[0] for r in forecasts_with(own).collect()] == ["failed"]
    for lost in (jvm.org.apache.spark.SparkException(aborted),
                 jvm.org.apache.spark.SparkException(aborted, jvm.java.io.IOException("No space left on device")),
                 jvm.org.apache.spark.SparkException(aborted, jvm.java.lang.OutOfMemoryError("Java heap space"))):
        with pytest.raises(Py4JJavaError):
            forecasts_with(lost)
    with pytest.raises(Py4JJavaError):
        forecasts_with(own, strict=True)


def broken_models():
    from skysense.queries import ml

    m = ml.MS[-1]
    model = PipelineModel([SQLTransformer(statement="SELECT *, raise_error('broken') AS predicted FROM __THIS__")])
    return {**{k: Trained(k, PipelineModel([SQLTransformer(statement=f"SELECT *, {k}_lag_1 AS predicted FROM __THIS__")]), ml.NAMES[k], None)
               for k in ml.MS[:1]}, m: Trained(m, model, ml.NAMES[m], None)}


@pytest.mark.parametrize("name", ["forecast_recursive_fixed", "forecast_status_fixed", "history_plus_forecast_fixed", "export_tables"])
def test_queries_fail_with_a_whole_measure(spark, sf, monkeypatch, name):
    from skysense.queries import QUERIES, ml

    monkeypatch.setattr(ml, "fixed_models", broken_models)
    with pytest.raises(Exception, match="broken"):
        QUERIES[name](spark, sf).collect()


def test_status_has_series_that_cant_be_forecast(spark, sf, monkeypatch, tmp_path):
    """One station short, one without a measure: the query and its SQL have a row with the reason for each."""
    import pyarrow.parquet as pq

    from skysense.queries import ORACLES, QUERIES
    from tests.oracle_check import TABLES, compare, connect

    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet") if t != "events" else None
    events = pq.read_table(f"{sf}/events.parquet").to_pandas()
    station = events.user_id % 4
    day = events.ts.min() + pd.Timedelta(hours=20)
    events = events[~((station == 0) & (events.ts >= day)) & ~((station == 1) & (events.event_type == "error"))]
    events.to_parquet(tmp_path / "events.parquet", index=False)
    folder = str(tmp_path)
    problem, n = compare(spark, connect(folder), "forecast_status_fixed", QUERIES["forecast_status_fixed"], ORACLES["forecast_status_fixed"], folder)
    assert not problem and n == 20
    rows = QUERIES["forecast_status_fixed"](spark, folder).collect()
    assert {r.station for r in rows if r.reason == "no full history" and r.hours == 0} == {0, 1} and {r.station for r in rows if r.hours == 24} == {2, 3}


def test_ranks_show_a_wrong_order(spark, trained, monkeypatch):
    from skysense.queries import QUERIES, ml

    monkeypatch.setattr(ml, "all_models", lambda spark, sf: None)
    monkeypatch.setattr(ml, "loaded", lambda store: {"pm2_5": trained})
    rows = QUERIES["importance_ranks"](spark, "").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(trained.features) + 1)) and all(r.sound for r in rows)
    monkeypatch.setattr(ml, "feature_importance", lambda t: feature_importance(t).orderBy("importance"))
    assert not all(r.sound for r in QUERIES["importance_ranks"](spark, "").collect())
