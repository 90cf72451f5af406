"""Trained models: training, store, scoring, importance and recursive forecasts.

What a fit gives isn't SQL. The queries over fitted models therefore return what is
determined (keys, times, actual values, names, numbers of samples) and whether the fitted
numbers are sound; ``feature_importance_values`` and ``validation_metrics`` return the
numbers themselves. The ``…_fixed`` queries run the same code with a fixed formula of the
features as the model, so that every value has a reference. All models have the default
parameters; they are trained once per session and folder, by the first query that needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysense.forecasting.models import (
    BoostingParams, ModelStore, Trained, feature_importance, learning_curves, predict_all as score_all, predict_measure as score,
    train_all as fit_all, train_measure as fit,
)
from skysense.forecasting.recursive import NO_HISTORY, forecast_all as forecasts, forecast_recursive as forecast
from skysense.forecasting.trees import Formula
from skysense.operators import air, impute, relational as rel, scoring
from skysense.operators.features import feature_names
from skysense.plans import cleaning
from skysense.queries.air import CAT, COLOR, aqi_sql
from skysense.queries.common import FILLED_SQL, HOURLY_SQL, HOURS, MS, each, hourly, interp_sql, long_sql, query, r
from skysense.session import materialize, new_path
from skysense.sources import readings, sinks

TARGET = "pm2_5"
#: Hours that the forecasts by formula go ahead.
FIXED_HOURS = 24
#: What this session has trained: by application, folder and what it is.
_KEPT: dict[tuple[str, str, str], object] = {}


def prepared(spark, sf):
    return materialize(cleaning.prepare_training(hourly(spark, sf), HOURS, MS, scale=None).data)


def filled(spark, sf):
    return materialize(impute.interpolate(hourly(spark, sf), HOURS, MS))


def kept(spark, sf, what: str, make):
    """``make()`` once per session and folder."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def trained(spark, sf) -> tuple[dict[str, Trained], DataFrame]:
    """A model per measure and the status table; the table has no ozone, which fails alone."""
    return kept(spark, sf, "all", lambda: fit_all(prepared(spark, sf), HOURS, [*MS, "o3"], parallel=len(MS)))


def one_model(spark, sf) -> Trained:
    if (spark.sparkContext.applicationId, sf, "all") in _KEPT:
        return trained(spark, sf)[0][TARGET]
    return kept(spark, sf, TARGET, lambda: fit(prepared(spark, sf), HOURS, TARGET))


def all_models(spark, sf) -> ModelStore:
    """A store with a model per measure."""
    def make() -> ModelStore:
        store = ModelStore(spark, new_path(spark, "models"))
        for t in trained(spark, sf)[0].values():
            store.save(t)
        return store

    return kept(spark, sf, "store", make)


def loaded(store: ModelStore) -> dict[str, Trained]:
    return {m: store.load(m) for m in MS if store.has(m)}


def finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def sound(metrics: DataFrame) -> Column:
    return finite("mae", "rmse", "mape", "r2") & (F.col("mae") <= F.col("rmse")) & (F.col("mae") >= 0) & (F.col("r2") <= 1)


def checked(predictions: DataFrame) -> DataFrame:
    """Determined columns of predictions, and whether error and prediction fit together."""
    exact = finite("predicted") & (F.col("error") == F.col("predicted") - F.col("actual"))
    return predictions.select("station", "datetime", "measure", "actual", exact.alias("sound"))


# Rows whose measures are all there, numbered; an hour's features need 24 rows before it.
FULL_SQL = f"""{FILLED_SQL}, whole AS (SELECT * FROM filled WHERE {each('{m} IS NOT NULL', sep=' AND ')}),
placed AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY datetime) - 1 AS p FROM filled),
usable AS (SELECT * FROM placed WHERE p >= 24 AND {each('{m} IS NOT NULL', sep=' AND ')}),
parts AS (SELECT n, floor(n * 0.7000000000000001::DOUBLE)::BIGINT AS a, floor(n * 0.8::DOUBLE)::BIGINT AS b
  FROM (SELECT station, count(*) AS n FROM whole GROUP BY 1)),
sizes AS (SELECT 'train' AS part, sum(greatest(a - 24, 0))::BIGINT AS samples FROM parts
  UNION ALL SELECT 'val', sum(greatest(b - a - 24, 0))::BIGINT FROM parts UNION ALL SELECT 'test', sum(greatest(n - b - 24, 0))::BIGINT FROM parts),
tested AS (SELECT sum(greatest(n - floor(n * 0.8::DOUBLE)::BIGINT - 24, 0))::BIGINT AS samples
  FROM (SELECT station, count(*) AS n FROM whole GROUP BY 1))"""
NAMES = {m: feature_names(m, [o for o in MS if o != m]) for m in MS}
NAMES_SQL = " UNION ALL ".join(f"SELECT '{m}' AS measure, unnest([{', '.join(repr(n) for n in NAMES[m])}]) AS feature" for m in MS)
MEASURES_SQL = f"(SELECT unnest([{', '.join(repr(m) for m in MS)}]) AS measure)"


@query("train_measure", f"WITH {FULL_SQL} SELECT '{TARGET}' AS measure, samples, true AS sound FROM tested")
def train_measure(spark, sf):
    """Default parameters for one measure; whether the test metrics are sound."""
    model = fit(prepared(spark, sf), HOURS, TARGET)
    kept(spark, sf, TARGET, lambda: model)
    metrics = model.metrics
    return metrics.select("measure", "samples", sound(metrics).alias("sound"))


@query("train_all", f"WITH {FULL_SQL} SELECT measure, 'ok' AS status, samples, true AS sound FROM {MEASURES_SQL}, tested UNION ALL SELECT 'o3', 'failed', NULL, NULL")
def train_all(spark, sf):
    """The status table of a training."""
    _, status = trained(spark, sf)
    return status.select("measure", F.split_part("status", F.lit(":"), F.lit(1)).alias("status"), "samples", sound(status).alias("sound")) \
        .withColumn("sound", F.when(F.col("status") == "ok", F.col("sound")))


@query("learning_curve", f"""WITH {FULL_SQL} SELECT measure, part, trees::BIGINT AS trees, samples, true AS sound
FROM {MEASURES_SQL}, sizes, range(1, 101) t(trees) WHERE samples > 0""")
def curve(spark, sf):
    """Every model's error after each tree; whether it is finite, and lower at the end than at the start on the training part."""
    made = curves(spark, sf)
    ends = made.filter(F.col("part") == "train").groupBy("measure").agg(
        (F.max_by("rmse", "trees") < F.min_by("rmse", "trees")).alias("learnt"))
    return made.join(F.broadcast(ends), "measure").select(
        "measure", "part", "trees", "samples", (finite("rmse") & (F.col("rmse") >= 0) & F.col("learnt")).alias("sound"))


@query("learning_curve_values", None)
def curve_values(spark, sf):
    """The errors themselves: measure, part, trees, samples, rmse."""
    return curves(spark, sf)


def curves(spark, sf) -> DataFrame:
    return kept(spark, sf, "curves", lambda: learning_curves(prepared(spark, sf), HOURS, trained(spark, sf)[0]))


@query("train_validated", f"""WITH {FULL_SQL}, known AS (SELECT samples > 0 AS enough FROM sizes WHERE part = 'val')
SELECT '{TARGET}' AS measure, CASE WHEN enough THEN 'ok' ELSE 'failed' END AS status, CASE WHEN enough THEN samples END AS samples,
CASE WHEN enough THEN true END AS fewer, CASE WHEN enough THEN true END AS sound FROM tested, known""")
def train_validated(spark, sf):
    """One measure with early stopping by the validation part; whether it kept at most the wanted trees.
    Where no validation row has a full history, training fails with that reason."""
    params = BoostingParams(early_stop=True)
    models, status = fit_all(prepared(spark, sf), HOURS, [TARGET], params)
    fewer = 1 <= models[TARGET].trees <= params.trees if models else None
    ok = F.col("status") == "ok"
    return status.select("measure", F.split_part("status", F.lit(":"), F.lit(1)).alias("status"), "samples",
                         F.lit(fewer).cast("boolean").alias("fewer"), F.when(ok, sound(status)).alias("sound"))


@query("metrics_table", f"WITH {FULL_SQL} SELECT measure, samples, {len(NAMES[TARGET])} AS features, true AS sound FROM {MEASURES_SQL}, tested")
def metrics_table(spark, sf):
    """Metrics and feature counts as written to the store and read back."""
    store = all_models(spark, sf)
    parts = [store.features(m).groupBy().agg(F.count(F.lit(1)).alias("features")).withColumn("measure", F.lit(m)) for m in MS if store.has(m)]
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    metrics = store.metrics(MS)
    return metrics.join(F.broadcast(counts), "measure").select("measure", "samples", "features", sound(metrics).alias("sound"))


@query("model_store", f"""WITH {FULL_SQL} SELECT measure, true AS has_model, (SELECT count(*) FROM usable) AS scored FROM {MEASURES_SQL}
UNION ALL SELECT 'o3', false, NULL""")
def model_store(spark, sf):
    """Which models can be loaded, and that they still score: rows scored per measure."""
    store = all_models(spark, sf)
    scored = score_all(filled(spark, sf), HOURS, loaded(store)).groupBy("measure").agg(F.count("predicted").alias("scored"))
    return store.presence([*MS, "o3"]).join(scored, "measure", "left")


@query("predict_measure", f"WITH {FULL_SQL} SELECT station, datetime, '{TARGET}' AS measure, {r(TARGET, 'actual')}, true AS sound FROM usable")
def predict_measure(spark, sf):
    return checked(score(filled(spark, sf), HOURS, one_model(spark, sf)))


@query("predict_all", f"WITH {FULL_SQL} {each('''SELECT station, datetime, '{m}' AS measure, round({m} + 1e-9, 6) + 0.0 AS actual, true AS sound FROM usable''', sep=' UNION ALL ')}")
def predict_all(spark, sf):
    return checked(score_all(filled(spark, sf), HOURS, loaded(all_models(spark, sf))))


@query("feature_importance", f"SELECT measure, feature, true AS sound FROM ({NAMES_SQL}) WHERE measure = '{TARGET}'")
def importance(spark, sf):
    return feature_importance(one_model(spark, sf)).select("measure", "feature", F.col("importance").between(0, 1).alias("sound"))


@query("importance_topk", f"SELECT measure, feature, true AS sound FROM ({NAMES_SQL})")
def importance_topk(spark, sf):
    """The features of every model, most important first; all of them."""
    rows = None
    for t in loaded(all_models(spark, sf)).values():
        table = feature_importance(t)
        rows = table if rows is None else rows.unionByName(table)
    return rows.select("measure", "feature", F.col("importance").between(0, 1).alias("sound"))


@query("feature_importance_values", None)
def importance_values(spark, sf):
    """The importances themselves: measure, rank, feature, importance."""
    rows = [(x.measure, rank, x.feature, x.importance) for t in loaded(all_models(spark, sf)).values()
            # One row per feature name, in the order of the table.
            for rank, x in enumerate(feature_importance(t).collect(), 1)]
    return spark.createDataFrame(rows, "measure string, rank long, feature string, importance double")


@query("validation_metrics", None)
def validation_metrics(spark, sf):
    """Errors of every model over the whole history: measure, samples, mae, rmse, mape, r2."""
    made = score_all(filled(spark, sf), HOURS, loaded(all_models(spark, sf)))
    return scoring.regression_metrics(made)


@query("importance_ranks", f"""SELECT measure, row_number() OVER (PARTITION BY measure ORDER BY feature) AS rank, true AS sound FROM ({NAMES_SQL})""")
def importance_ranks(spark, sf):
    """The ranks in the order of ``importance_topk``, and whether importances don't rise with them."""
    rows = []
    for t in loaded(all_models(spark, sf)).values():
        before = 1.0
        # One row per feature name, in the order of the table.
        for rank, x in enumerate(feature_importance(t).collect(), 1):
            rows.append((x.measure, rank, 0 <= x.importance <= before))
            before = x.importance
    return spark.createDataFrame(rows, "measure string, rank long, sound boolean")


@query("validate_history", f"""WITH {FULL_SQL} SELECT f.station, f.datetime, {each('round(f.{m} + 1e-9, 6) + 0.0 AS {m}, u.station IS NOT NULL AS {m}_scored')}, true AS sound
FROM filled f LEFT JOIN usable u ON u.station = f.station AND u.datetime = f.datetime""")
def validate_history(spark, sf):
    """Predictions of every model next to the readings, and whether their errors are sound."""
    h = filled(spark, sf)
    made = materialize(score_all(h, HOURS, loaded(all_models(spark, sf))))
    metrics = scoring.regression_metrics(made)
    ok = metrics.agg(F.bool_and(sound(metrics)).alias("sound"))
    wide = rel.combine_predictions(h, made, HOURS, MS)
    return wide.select("station", "datetime", *[c for m in MS for c in (F.col(m), F.col(f"{m}_predicted").isNotNull().alias(f"{m}_scored"))]) \
        .crossJoin(F.broadcast(ok))


@query("aqi_from_predictions", f"WITH {FULL_SQL} SELECT station, datetime, true AS sound FROM usable")
def aqi_from_predictions(spark, sf):
    made = score(filled(spark, sf), HOURS, one_model(spark, sf))
    rated = air.with_aqi(made.select("station", "datetime", "predicted"), "predicted", mode="strict")
    return rated.select("station", "datetime", (F.col("aqi").between(0, 500) & F.col("category").isNotNull()).alias("sound"))


# The last rows of a station, if they are full; the hours after them.
LAST_SQL = f"""{FULL_SQL}, {long_sql('filled')}, tail AS (
  SELECT station, measure, list(value ORDER BY datetime)[-48:] AS ctx, max(datetime) AS t0 FROM long GROUP BY 1, 2),
ready AS (SELECT t.*, w.* EXCLUDE (station, datetime) FROM tail t JOIN whole w ON w.station = t.station AND w.datetime = t.t0
  WHERE len(ctx) >= 25 AND len(list_filter(ctx, lambda x: x IS NULL)) = 0)"""


# Whether any of a series' last 48 rows has a full history and all measures; else the reason.
STATUS_SQL = f"""recent AS (
  SELECT l.station, l.measure, l.datetime, l.value, w.station IS NOT NULL AS known
  FROM long l LEFT JOIN whole w ON w.station = l.station AND w.datetime = l.datetime
  QUALIFY row_number() OVER (PARTITION BY l.station, l.measure ORDER BY l.datetime DESC) <= 48),
starts AS (SELECT station, measure, known AND count(value) OVER (PARTITION BY station, measure ORDER BY datetime ROWS 24 PRECEDING) = 25 AS fit FROM recent),
status AS (SELECT station, measure, CASE WHEN NOT bool_or(fit) THEN '{NO_HISTORY}' END AS reason FROM starts GROUP BY 1, 2)"""


@query("forecast_recursive", f"""WITH {LAST_SQL}, {STATUS_SQL}
SELECT station, measure, i::BIGINT AS step, t0 + to_hours(i) AS datetime, true AS sound, NULL AS reason
FROM ready, range(1, 25) t(i) WHERE measure = '{TARGET}'
UNION ALL SELECT station, measure, NULL, NULL, NULL, reason FROM status WHERE measure = '{TARGET}' AND reason IS NOT NULL""")
def forecast_recursive(spark, sf):
    made = forecast(filled(spark, sf), HOURS, one_model(spark, sf))
    reason = F.split_part("reason", F.lit(":"), F.lit(1))
    return made.select("station", "measure", "step", "datetime", F.when(F.col("reason").isNull(), finite("forecast")).alias("sound"),
                       reason.alias("reason"))


# ---- the same with a fixed formula ----

def first_other(m: str) -> str:
    return next(o for o in MS if o != m)


def fixed_formula(m: str):
    return lambda c: (0.5 * c(f"{m}_lag_1") + 0.3 * c(f"{m}_rolling_mean_6") + 0.1 * c(f"{m}_lag_24")
                      + 0.01 * c(f"{m}_rolling_std_12") + 0.05 * c(first_other(m)) + 0.01 * c("hour"))


def fixed_models() -> dict[str, Trained]:
    return {m: Trained(m, Formula(NAMES[m], fixed_formula(m)), NAMES[m], None) for m in MS}


BY = "PARTITION BY station ORDER BY datetime"


def _window_formula(m: str) -> str:
    return (f"0.5 * lag({m}, 1) OVER ({BY}) + 0.3 * avg({m}) OVER ({BY} ROWS 5 PRECEDING) + 0.1 * lag({m}, 24) OVER ({BY}) "
            f"+ 0.01 * stddev_samp({m}) OVER ({BY} ROWS 11 PRECEDING) + 0.05 * {first_other(m)} + 0.01 * hour(datetime)")


FIXED_SQL = f"""{FULL_SQL}, valued AS (SELECT *, {', '.join(f'{_window_formula(m)} AS x_{m}' for m in MS)} FROM placed),
fixed AS ({' UNION ALL '.join(f"SELECT station, datetime, '{m}' AS measure, {m} AS actual, x_{m} AS predicted FROM valued WHERE p >= 24 AND {each('{m} IS NOT NULL', sep=' AND ')}" for m in MS)})"""


@query("predict_fixed", f"""WITH {FIXED_SQL} SELECT station, datetime, measure, {r("actual")}, {r("predicted")}, {r("predicted - actual", "error")},
{r("(predicted - actual) / nullif(actual, 0) * 100", "error_pct")} FROM fixed""")
def predict_fixed(spark, sf):
    return score_all(filled(spark, sf), HOURS, fixed_models())


@query("validate_fixed", f"""WITH {FIXED_SQL}, w AS (SELECT station, datetime, {each("max(predicted) FILTER (WHERE measure = '{m}') AS {m}_predicted")} FROM fixed GROUP BY 1, 2)
SELECT f.station, f.datetime, {each('round(f.{m} + 1e-9, 6) + 0.0 AS {m}, round(w.{m}_predicted + 1e-9, 6) + 0.0 AS {m}_predicted')}
FROM filled f LEFT JOIN w ON w.station = f.station AND w.datetime = f.datetime""")
def validate_fixed(spark, sf):
    h = filled(spark, sf)
    return rel.combine_predictions(h, score_all(h, HOURS, fixed_models()), HOURS, MS)


@query("aqi_from_fixed", f"""WITH {FIXED_SQL}, a AS (SELECT station, datetime, predicted, {aqi_sql('predicted', '500')} AS aqi FROM fixed WHERE measure = '{TARGET}')
SELECT station, datetime, {r("predicted")}, aqi, {CAT} AS category, {COLOR} AS color FROM a""")
def aqi_from_fixed(spark, sf):
    made = score(filled(spark, sf), HOURS, fixed_models()[TARGET])
    return air.with_aqi(made.select("station", "datetime", "predicted"), "predicted", mode="strict")


OTHER_SQL = "CASE measure " + " ".join(f"WHEN '{m}' THEN {first_other(m)}" for m in MS) + " END"
AHEAD_SQL = f"""{LAST_SQL}, ahead AS (
  SELECT station, measure, 0 AS step, ctx, t0, {OTHER_SQL} AS other, NULL::DOUBLE AS forecast FROM ready
  UNION ALL
  SELECT station, measure, step + 1, list_append(ctx, x), t0, other, x FROM (
    SELECT *, 0.5 * ctx[-2] + 0.3 * list_avg(ctx[-6:]) + 0.1 * ctx[-25] + 0.01 * list_aggregate(ctx[-12:], 'stddev_samp')
      + 0.05 * other + 0.01 * hour(t0 + to_hours(step)) AS x FROM ahead WHERE step < {FIXED_HOURS}))"""


@query("forecast_recursive_fixed", f"""WITH RECURSIVE {AHEAD_SQL} SELECT station, measure, step::BIGINT AS step, t0 + to_hours(step) AS datetime, {r("forecast")}
FROM ahead WHERE step > 0""")
def forecast_recursive_fixed(spark, sf):
    """Some hours ahead for every measure that has a full history; ``forecast_status_fixed`` has all
    of them, and the reasons. An error of a whole measure is raised."""
    made = forecasts(filled(spark, sf), HOURS, fixed_models(), FIXED_HOURS, strict=True)
    return made.filter(F.col("reason").isNull()).drop("reason")


@query("forecast_status_fixed", f"""WITH {FULL_SQL}, {long_sql('filled')}, {STATUS_SQL}
SELECT station, measure, CASE WHEN reason IS NULL THEN {FIXED_HOURS} ELSE 0 END::BIGINT AS hours, reason FROM status""")
def forecast_status_fixed(spark, sf):
    """Every series and measure: how many hours are forecast, or the reason why there are none."""
    made = forecasts(filled(spark, sf), HOURS, fixed_models(), FIXED_HOURS, strict=True)
    return made.groupBy("station", "measure").agg(
        F.count("step").alias("hours"), F.max(F.split_part("reason", F.lit(":"), F.lit(1))).alias("reason"))


@query("history_plus_forecast_fixed", f"""WITH RECURSIVE {AHEAD_SQL}, ranked AS (
  SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY station, measure ORDER BY datetime DESC) <= 168)
SELECT station, datetime, measure, {r("value")}, 'Historical' AS series FROM ranked
UNION ALL SELECT station, t0 + to_hours(step), measure, {r("forecast", "value")}, 'Forecast' FROM ahead WHERE step > 0""")
def history_plus_forecast_fixed(spark, sf):
    h = filled(spark, sf)
    ahead = forecasts(h, HOURS, fixed_models(), FIXED_HOURS, strict=True)
    return rel.history_plus_forecast(h, ahead.filter(F.col("reason").isNull()), HOURS, MS, 168)


@query("export_tables", f"""WITH {HOURLY_SQL}
SELECT 'cleaned' AS export, sum(n)::BIGINT AS "rows" FROM (SELECT date_diff('hour', min(datetime), max(datetime)) + 1 AS n FROM hourly GROUP BY station)
UNION ALL SELECT 'processed', count(*) FROM hourly UNION ALL SELECT 'predictions', count(*) FROM hourly
UNION ALL SELECT 'forecast', {FIXED_HOURS} * count(*) FROM (WITH {LAST_SQL} SELECT * FROM ready)""")
def export_tables(spark, sf):
    """The four CSV exports, and the number of rows that come back from each."""
    h = hourly(spark, sf)
    cleaned = cleaning.clean(readings.event_rows(spark, sf), HOURS, "event_id").data
    done = materialize(impute.interpolate(h, HOURS, MS))
    made = scoring.persistence(done, HOURS, MS)
    ahead = forecasts(done, HOURS, fixed_models(), FIXED_HOURS, strict=True)
    tables = {"cleaned": cleaned, "processed": cleaning.prepare_upload(h, HOURS),
              "predictions": rel.combine_predictions(h, made, HOURS, MS),
              "forecast": ahead.filter(F.col("reason").isNull()).drop("reason")}
    out = None
    for name, df in tables.items():
        path = sinks.export_csv(df, new_path(spark, f"export-{name}"))
        back = spark.read.option("header", True).schema(sinks.with_labels(df).schema).csv(path)
        n = back.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("export"), "rows")
        out = n if out is None else out.unionByName(n)
    return out
