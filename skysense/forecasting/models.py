"""Training, storing and applying one gradient-boosted regressor per measure."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysense.constants import (
    GBT_DEPTH, GBT_FEATURE_SHARE, GBT_SEED, GBT_STEP, GBT_SUBSAMPLE, GBT_TREES, LOOKBACK,
)
from skysense.operators.features import features_of, supervised_features, wide_features
from skysense.operators.relational import align_features
from skysense.operators.scoring import prediction_errors, regression_metrics
from skysense.series import Series
from skysense.session import materialize, shared_dir


TRAIN_ROWS_PER_TASK = 100_000
METRICS = "measure string, samples long, mae double, rmse double, mape double, r2 double"
FEATURES = "position int, feature string"


@dataclass(frozen=True)
class BoostingParams:
    """``early_stop`` watches the error on the validation part while trees are added, stops once a
    tree lowers it by less than ``tolerance`` (relative) and keeps the trees up to the best."""

    trees: int = GBT_TREES
    depth: int = GBT_DEPTH
    step: float = GBT_STEP
    subsample: float = GBT_SUBSAMPLE
    feature_share: str = GBT_FEATURE_SHARE
    seed: int = GBT_SEED
    lookback: int = LOOKBACK
    early_stop: bool = False
    tolerance: float = 0.01

    def regressor(self) -> GBTRegressor:
        made = GBTRegressor(featuresCol="features", labelCol="label", predictionCol="predicted", maxIter=self.trees,
                            maxDepth=self.depth, stepSize=self.step, subsamplingRate=self.subsample,
                            featureSubsetStrategy=self.feature_share, seed=self.seed, maxMemoryInMB=1024)
        if self.early_stop:
            made = made.setParams(validationIndicatorCol="validating", validationTol=self.tolerance)
        return made


@dataclass(frozen=True)
class Trained:
    measure: str
    model: PipelineModel
    features: list[str]
    metrics: DataFrame | None

    @property
    def trees(self) -> int:
        """How many trees the model has, which early stopping may have made fewer."""
        return self.model.stages[-1].getNumTrees


def feature_columns(df: DataFrame, s: Series, target: str) -> list[str]:
    return [c for c in df.columns if c not in (*s.keys, s.ts, target, "split")]


def train_measure(split: DataFrame, s: Series, target: str, params: BoostingParams = BoostingParams(), *,
                  leak_free: bool = False, step: int | None = None) -> Trained:
    """Fit on the training part of ``split`` and measure on its test part.

    Features are made within each part, so the first ``lookback`` rows of every part
    are lost and none of them sees across a border. ``step`` says that rows are on a grid.
    """
    parts = s.within("split")
    return train_on(materialize(supervised_features(
        split, parts, target, lookback=params.lookback, leak_free=leak_free, step=step)), s, target, params)


def by_rows(df: DataFrame, rows: int = TRAIN_ROWS_PER_TASK) -> DataFrame:
    """``df`` (stored) in as many tasks as its rows need. Boosting runs several jobs per
    tree, whose fixed cost per task is all there is to a small table."""
    return df.repartition(max(1, -(-df.count() // rows)))


def train_on(rows: DataFrame, s: Series, target: str, params: BoostingParams) -> Trained:
    """Fit and measure on stored features with a ``split`` column.

    With ``early_stop`` the validation part takes part in the fit, as the rows that decide on
    the number of trees; a part without a row of full history is an error then.
    """
    shared_dir(rows.sparkSession)
    names = feature_columns(rows, s, target)
    labelled = rows.withColumn("label", F.col(target))
    stages = [VectorAssembler(inputCols=names, outputCol="features"), params.regressor()]
    fitted_on = labelled.filter(F.col("split") == "train")
    if params.early_stop:
        if labelled.filter(F.col("split") == "val").isEmpty():
            raise ValueError(f"no validation row of {target} has a full history, so nothing tells when to stop")
        fitted_on = labelled.filter(F.col("split").isin("train", "val")).withColumn("validating", F.col("split") == "val")
    model = Pipeline(stages=stages).fit(by_rows(fitted_on))
    test = labelled.filter(F.col("split") == "test")
    scored = model.transform(test).select(F.lit(target).alias("measure"), F.col("label").alias("actual"), "predicted")
    return Trained(target, model, names, regression_metrics(scored))


def train_all(split: DataFrame, s: Series, measures: Sequence[str], params: BoostingParams = BoostingParams(), *,
              parallel: int = 4, step: int | None = None) -> tuple[dict[str, Trained], DataFrame]:
    """One model per measure, from one pass that makes the features of all; the fits run
    side by side as separate Spark jobs.

    Returns the models and a table (measure, status, samples, mae, rmse, mape, r2); a
    measure whose training fails has its error there and does not stop the others.
    """
    spark = split.sparkSession
    parts = s.within("split")
    known = [m for m in measures if m in split.columns]
    wide = materialize(wide_features(split, parts, known, lookback=params.lookback, step=step)) if known else split

    def one(m: str) -> tuple[str, Trained | None, str]:
        try:
            if m not in split.columns:
                raise ValueError(f"the table has no column {m}")
            return m, train_on(features_of(wide, split, parts, m, params.lookback), s, m, params), "ok"
        except Exception as error:  # reported per measure
            return m, None, f"failed: {error}"

    with ThreadPool(parallel) as pool:
        results = pool.map(one, measures)
    models = {m: t for m, t, _ in results if t}
    status = spark.createDataFrame([(m, text) for m, _, text in results], "measure string, status string")
    metrics = None
    for t in models.values():
        metrics = t.metrics if metrics is None else metrics.unionByName(t.metrics)
    if metrics is None:
        metrics = spark.createDataFrame([], METRICS)
    return models, status.join(F.broadcast(materialize(metrics)), "measure", "left")


def learning_curve(split: DataFrame, s: Series, trained: Trained, *, lookback: int = LOOKBACK,
                   leak_free: bool = False, step: int | None = None) -> DataFrame:
    """(measure, part, trees, samples, rmse): the error on each part of ``split`` after every tree.

    Features are made as in ``train_measure``, whose ``lookback`` and ``leak_free`` must be the
    same. A part without a row of full history has no rows. One pass over each part evaluates
    all trees; what comes back is one number per tree.
    """
    parts = s.within("split")
    rows = materialize(supervised_features(split, parts, trained.measure, lookback=lookback, leak_free=leak_free, step=step))
    return _curves(rows.sparkSession, [(rows, trained)])


def learning_curves(split: DataFrame, s: Series, models: dict[str, Trained], *, lookback: int = LOOKBACK,
                    step: int | None = None) -> DataFrame:
    """``learning_curve`` of all ``models``, whose features are made along the rows once."""
    parts = s.within("split")
    wide = materialize(wide_features(split, parts, list(models), lookback=lookback, step=step))
    return _curves(split.sparkSession, [(features_of(wide, split, parts, m, lookback), t) for m, t in models.items()])


def _curves(spark: SparkSession, fits: Sequence[tuple[DataFrame, Trained]]) -> DataFrame:
    rows = []
    for table, t in fits:
        boosted = t.model.stages[-1] if isinstance(t.model, PipelineModel) else t.model
        if not isinstance(boosted, GBTRegressionModel):
            raise ValueError(f"the model of {t.measure} isn't boosted, so it has no error after every tree")
        ready = PipelineModel(t.model.stages[:-1]).transform(table.withColumn("label", F.col(t.measure)))
        sizes = {r["split"]: r["count"] for r in table.groupBy("split").count().collect()}
        for part in [p for p in ("train", "val", "test") if sizes.get(p)]:
            errors = boosted.evaluateEachIteration(ready.filter(F.col("split") == part), "squared")
            rows += [(t.measure, part, n, sizes[part], math.sqrt(e)) for n, e in enumerate(errors, 1)]
    return spark.createDataFrame(rows, "measure string, part string, trees int, samples long, rmse double")


def feature_importance(trained: Trained) -> DataFrame:
    """(measure, feature, importance), most important first; one row per feature."""
    weights = trained.model.stages[-1].featureImportances.toArray()
    rows = [(trained.measure, n, float(w)) for n, w in zip(trained.features, weights)]
    spark = trained.metrics.sparkSession
    return (spark.createDataFrame(rows, "measure string, feature string, importance double")
            .orderBy(F.desc("importance"), "feature"))


class ModelStore:
    """A folder with one sub-folder per measure, which holds versions and a manifest.

    A version is a folder of its own with model, ordered feature names and metrics. It counts
    from the moment its line is in the manifest, which is written last: whoever reads while a
    model is saved, or after a save that was cut off, gets the version before as a whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self, measure: str) -> str:
        return f"{self.path}/{measure}/manifest"

    def versions(self, measure: str) -> list[tuple[int, str]]:
        """(number, folder) of the versions that count, oldest first; one for each save."""
        try:
            lines = self.spark.read.schema("number long, version string").json(self._manifest(measure))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((r["number"], f"{self.path}/{measure}/{r['version']}") for r in lines.collect())

    def _current(self, measure: str) -> str:
        found = self.versions(measure)
        if not found:
            raise ValueError(f"the store has no model of {measure}")
        return found[-1][1]

    def save(self, t: Trained) -> None:
        version = uuid.uuid4().hex
        base = f"{self.path}/{t.measure}/{version}"
        t.model.write().save(f"{base}/model")
        names = [(i, n) for i, n in enumerate(t.features)]
        self.spark.createDataFrame(names, FEATURES).coalesce(1).write.json(f"{base}/features")
        t.metrics.coalesce(1).write.json(f"{base}/metrics")
        self._publish(t.measure, version)

    def _publish(self, measure: str, version: str) -> None:
        number = max((n for n, _ in self.versions(measure)), default=0) + 1
        line = self.spark.createDataFrame([(number, version)], "number long, version string").coalesce(1)
        line.write.mode("append").json(self._manifest(measure))

    def has(self, measure: str) -> bool:
        return bool(self.versions(measure))

    def presence(self, measures: Sequence[str]) -> DataFrame:
        return self.spark.createDataFrame([(m, self.has(m)) for m in measures], "measure string, has_model boolean")

    def features(self, measure: str) -> DataFrame:
        return self.spark.read.schema(FEATURES).json(f"{self._current(measure)}/features")

    def metrics(self, measures: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(METRICS).json([f"{self._current(m)}/metrics" for m in measures if self.has(m)])

    def load(self, measure: str) -> Trained:
        base = self._current(measure)
        listed = self.spark.read.schema(FEATURES).json(f"{base}/features")
        names = [r["feature"] for r in listed.orderBy("position").collect()]
        metrics = self.spark.read.schema(METRICS).json(f"{base}/metrics")
        return Trained(measure, PipelineModel.load(f"{base}/model"), names, metrics)


def predict_measure(df: DataFrame, s: Series, trained: Trained, *, lookback: int = LOOKBACK,
                    step: int | None = None) -> DataFrame:
    """Long predictions with errors for every row that has a full history."""
    return _scored(supervised_features(df, s, trained.measure, lookback=lookback, step=step), s, trained)


def _scored(rows: DataFrame, s: Series, trained: Trained) -> DataFrame:
    m = trained.measure
    aligned = align_features(rows, trained.features, keep=[*s.keys, s.ts, F.col(m).alias("_actual")])
    scored = trained.model.transform(aligned)
    out = scored.select(*s.keys, s.ts, F.lit(m).alias("measure"), F.col("_actual").alias("actual"), "predicted")
    return prediction_errors(out)


def predict_all(df: DataFrame, s: Series, models: dict[str, Trained], *, lookback: int = LOOKBACK,
                step: int | None = None) -> DataFrame:
    """Predictions of every measure that the table holds and a model exists for.

    The features of all measures are made along the rows once and stored; each model then
    reads the columns it needs.
    """
    known = {m: t for m, t in models.items() if m in df.columns}
    if not known:
        raise ValueError("the table has no measure with a model")
    wide = materialize(wide_features(df, s, list(known), lookback=lookback, step=step))
    out = None
    for m, t in known.items():
        part = _scored(features_of(wide, df, s, m, lookback), s, t)
        out = part if out is None else out.unionByName(part)
    return out
