"""Recursive forecasts, all series side by side.

The state of a series is one row: its last values as an array. A step computes the
features from the array with column expressions, applies the model and appends the
prediction. Steps are projections, so rows never move. With a tree model all steps are one
expression, because the trees are data in it (see ``trees``). Any other model is applied
step by step, and the plan is cut by a stored table every few steps. Formulas are
expressions too.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysense.constants import FORECAST_HOURS, LOOKBACK, ROLLING_WINDOWS
from skysense.forecasting.models import Trained
from skysense.forecasting.trees import Forest, Formula, expression_of
from skysense.functions.timeaxis import from_seconds, seconds
from skysense.operators.features import TIME_FEATURES, time_columns
from skysense.operators.grid import HOUR
from skysense.operators.relational import tail_n
from skysense.series import Series
from skysense.session import materialize

#: The plan of a step holds that of the step before it several times.
STEPS_PER_STAGE = 2
#: What a reason begins with, before a colon and the details.
NO_HISTORY, FAILED = "no full history", "failed"
#: Errors that a measure's values or its model raise, wherever they stand among the causes.
OWN_ERRORS = (
    "org.apache.spark.sql.AnalysisException", "org.apache.spark.SparkRuntimeException", "java.lang.IllegalArgumentException",
    "java.lang.ArithmeticException", "java.lang.ArrayIndexOutOfBoundsException", "java.time.DateTimeException")


def _last(values: Column, n: int) -> Column:
    return F.slice(values, -n, n)


def _history_columns(target: str, lookback: int, ctx: Column, place: Column) -> dict[str, Column]:
    """Features of the row at ``place`` (from 1) of the context."""
    cols = {f"{target}_lag_{k}": F.get(ctx, place - (k + 1)) for k in range(1, lookback + 1)}
    for w in ROLLING_WINDOWS:
        if w <= lookback:
            frame = F.slice(ctx, place - (w - 1), w)
            mean = F.aggregate(frame, F.lit(0.0), lambda a, x: a + x) / w
            cols[f"{target}_rolling_mean_{w}"] = mean
            start = F.struct(F.lit(0.0).alias("s"), mean.alias("m"))
            cols[f"{target}_rolling_std_{w}"] = F.sqrt(F.aggregate(
                frame, start, lambda a, x: F.struct((a.s + (x - a.m) * (x - a.m)).alias("s"), a.m.alias("m")), lambda a: a.s) / (w - 1))
    return cols


def _full(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull())


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def contexts(df: DataFrame, s: Series, columns: list[str], size: int) -> DataFrame:
    """The last ``size`` rows of every series as the array ``_rows``, stored."""
    recent = tail_n(df.select(*s.keys, *s.order, *columns), s, size)
    # At most ``size`` rows per series are gathered here.
    rows = F.array_sort(F.collect_list(F.struct(*s.order, F.struct(
        F.lit(1).alias("_"), *[F.col(c).cast("double").alias(c) for c in columns]).alias("o"))))
    return materialize(recent.groupBy(*s.keys).agg(rows.alias("_rows")))


def _others(df: DataFrame, trained: Trained) -> list[str]:
    return [c for c in trained.features if c in df.columns and c not in TIME_FEATURES and c != trained.measure]


def _known(o: Column, others: list[str]) -> Column:
    out = F.lit(True)
    for name in others:
        out = out & o[name].isNotNull()
    return out


def _starts(gathered: DataFrame, s: Series, m: str, others: list[str], lookback: int) -> DataFrame:
    """Per series: time of the last row, values of ``m``, place and time of the last full row, other measures there."""
    ctx, n = F.transform("_rows", lambda r: r["o"][m]), F.size("_rows")
    # The places are right for short series too, because a condition around them may be evaluated after them.
    first = F.lit(lookback + 1)
    places = F.filter(F.sequence(first, F.greatest(first, n)), lambda i: (i <= n) & _full(
        F.slice(ctx, i - lookback, lookback + 1)) & _known(F.get("_rows", i - 1)["o"], others))
    last = F.element_at("_rows", -1)
    state = gathered.withColumn("_place", F.array_max(places))
    at = F.when(F.col("_place").isNotNull(), F.element_at("_rows", F.coalesce("_place", F.lit(1))))
    return state.select(
        *s.keys, last[s.ts].alias("_t0"), ctx.alias("_ctx"), F.array().cast("array<double>").alias("_preds"),
        last["o"].alias("_last"), "_place", at[s.ts].alias("_now"), at["o"].alias("_others"))


def _stepwise(state: DataFrame, s: Series, trained: Trained, others: list[str], hours: int, lookback: int) -> DataFrame:
    """``_t0`` and ``_preds`` by applying the model to the states, hour by hour."""
    state = materialize(state)
    own = ["_t0", "_ctx", "_preds", "_last", "_place", "_now", "_others"]
    made = {**_history_columns(trained.measure, lookback, F.col("_ctx"), F.col("_place")), **dict(zip(TIME_FEATURES, time_columns("_now"))),
            **{o: F.col("_others")[o] for o in others}}
    features = [made.get(name, F.lit(0.0)).cast("double").alias(name) for name in trained.features]
    for i in range(hours):
        scored = trained.model.transform(state.select(*s.keys, *own, *features))
        grown = F.array_append("_ctx", F.col("predicted").cast("double"))
        moved = scored.select(*s.keys, "_t0", grown.alias("_ctx"), F.array_append("_preds", F.col("predicted").cast("double")).alias("_preds"),
                              "_last", "_place", "_now", "_others")
        # The appended row is the next one to predict from if its own history is full.
        usable = _full(_last(F.col("_ctx"), lookback + 1)) & _known(F.col("_last"), others)
        state = moved.select(
            *s.keys, "_t0", "_ctx", "_preds", "_last", F.when(usable, F.size("_ctx")).otherwise(F.col("_place")).alias("_place"),
            F.when(usable, from_seconds(seconds("_t0") + F.lit((i + 1) * HOUR))).otherwise(F.col("_now")).alias("_now"),
            F.when(usable, F.col("_last")).otherwise(F.col("_others")).alias("_others"))
        if (i + 1) % STEPS_PER_STAGE == 0 and i + 1 < hours:
            state = materialize(state)
    return state


def _in_one(state: DataFrame, s: Series, trained: Trained, forest: Forest | Formula, others: list[str], hours: int, lookback: int) -> DataFrame:
    """``_t0`` and ``_preds`` as one expression per series; the trees are one broadcast row, as large as the model."""
    begin = F.struct(F.col("_ctx").alias("ctx"), F.array().cast("array<double>").alias("preds"), F.col("_place").alias("place"),
                     seconds("_now").alias("now"), F.lit(False).alias("moved"))

    def step(st: Column, i: Column) -> Column:
        made = {**_history_columns(trained.measure, lookback, st.ctx, st.place),
                **dict(zip(TIME_FEATURES, time_columns(from_seconds(st.now)))),
                **{o: F.when(st.moved, F.col("_last")[o]).otherwise(F.col("_others")[o]) for o in others}}
        x = F.array(*[made.get(name, F.lit(0.0)).cast("double") for name in forest.inputs])

        def after(p: Column) -> Column:
            def grown(ctx: Column) -> Column:
                # The appended row is the next one to predict from if its own history is full.
                # Short series are left out before, but Spark may evaluate this for them too.
                usable = (F.size(ctx) > lookback) & _full(_last(ctx, lookback + 1)) & _known(F.col("_last"), others)
                return F.struct(
                    ctx.alias("ctx"), F.concat(st.preds, F.array(p)).alias("preds"), F.when(usable, F.size(ctx)).otherwise(st.place).alias("place"),
                    F.when(usable, seconds("_t0") + i * HOUR).otherwise(st.now).alias("now"), (st.moved | usable).alias("moved"))

            return _let(F.concat(st.ctx, F.array(p)), grown)

        return _let(_let(x, lambda v: forest.score(v, F.col("_forest"))), after)

    preds = F.aggregate(F.sequence(F.lit(1), F.lit(hours)), begin, step, lambda st: st.preds)
    return state.crossJoin(F.broadcast(forest.row(state.sparkSession))).select(*s.keys, "_t0", preds.alias("_preds"))


def _ahead(gathered: DataFrame, s: Series, trained: Trained, others: list[str], hours: int, *, lookback: int = LOOKBACK,
           aligned: bool = False, walk: bool = True) -> DataFrame:
    m = trained.measure
    starts = _starts(gathered, s, m, others, lookback)
    state, without = starts.filter(F.col("_place").isNotNull()), starts.filter(F.col("_place").isNull())
    forest = expression_of(trained.model) if walk else None
    if forest:
        state = _in_one(state, s, trained, forest, others, hours, lookback)
    else:
        state = _stepwise(state, s, trained, others, hours, lookback)
    shift = 0 if aligned else 1
    steps = state.select(*s.keys, "_t0", F.posexplode("_preds").alias("_i", "forecast"))
    made_rows = steps.select(
        *s.keys, F.lit(m).alias("measure"), (F.col("_i") + 1).alias("step"),
        from_seconds(seconds("_t0") + (F.col("_i") + F.lit(shift)) * HOUR).alias(s.ts), "forecast",
        F.lit(None).cast("string").alias("reason"))
    return made_rows.unionByName(without.select(
        *s.keys, F.lit(m).alias("measure"), F.lit(None).cast("int").alias("step"), F.lit(None).cast("timestamp_ntz").alias(s.ts),
        F.lit(None).cast("double").alias("forecast"),
        F.concat(F.lit(f"{NO_HISTORY}: none of the last {2 * lookback} rows has {lookback + 1} values and all other measures; rows there: "),
                 F.size("_ctx").cast("string")).alias("reason")))


def _hours(hours: int) -> int:
    if hours < 1:
        raise ValueError("hours must be at least 1")
    return hours


def forecast_recursive(df: DataFrame, s: Series, trained: Trained, hours: int = FORECAST_HOURS, *,
                       lookback: int = LOOKBACK, aligned: bool = False, walk: bool = True) -> DataFrame:
    """``(keys, measure, step, ts, forecast, reason)`` for the next ``hours`` of every series.

    The context is the last ``2 * lookback`` rows. Each step predicts from the last row
    with a full history (``lookback`` values before its own, and the other measures) and
    labels the result one hour later than the step before; ``aligned`` labels it an hour
    earlier. The prediction is appended with the other measures of the last row. A series
    without such a row has one row with a ``reason`` and no forecast; the others go on.
    ``walk=False`` applies such models step by step too.
    """
    _hours(hours)
    others = _others(df, trained)
    gathered = contexts(df, s, [trained.measure, *others], 2 * lookback)
    return _ahead(gathered, s, trained, others, hours, lookback=lookback, aligned=aligned, walk=walk)


def _own(spark: SparkSession, error: Exception) -> bool:
    """Whether a measure's values or model raised ``error``; lost executors, memory and storage aren't its own."""
    # The session raises known errors as its own and others as they come from the JVM.
    e, own = getattr(error, "java_exception", None) or getattr(error, "_origin", None), False
    gateway = spark.sparkContext._gateway
    while e is not None:
        if is_instance_of(gateway, e, "java.lang.Error"):
            return False
        own = own or any(is_instance_of(gateway, e, name) for name in OWN_ERRORS)
        e = e.getCause()
    return own


def forecast_all(df: DataFrame, s: Series, models: Mapping[str, Trained], hours: int = FORECAST_HOURS, *,
                 strict: bool = False, **options) -> DataFrame:
    """Forecasts of every measure that has a model. A measure whose values or model raise an
    error has one row with it as ``reason``, and the others go on; with ``strict`` the error
    is raised. Other errors, such as lost tasks, always are."""
    spark, lookback = df.sparkSession, options.get("lookback", LOOKBACK)
    _hours(hours)
    if not models:
        raise ValueError("there is no model")
    wanted = dict.fromkeys(c for t in models.values() for c in (t.measure, *_others(df, t)) if c in df.columns)
    gathered = contexts(df, s, list(wanted), 2 * lookback)

    def ahead(m: str, *, store: bool) -> DataFrame:
        try:
            made = _ahead(gathered, s, models[m], _others(df, models[m]), hours, **options)
            # Stored here, because errors come up when rows are made.
            return materialize(made) if store else made
        except (PySparkException, Py4JJavaError) as error:  # reported per measure
            if strict or not _own(spark, error):
                raise
            fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in s.keys)
            return spark.createDataFrame(
                [(*[None] * len(s.keys), m, None, None, None, f"{FAILED}: {error}")],
                f"{fields + ', ' if fields else ''}measure string, step int, `{s.ts}` timestamp_ntz, forecast double, reason string")

    # Measures whose models are expressions are made together; if one of them fails, each is made alone.
    together = [m for m, t in models.items() if expression_of(t.model)]
    parts = [ahead(m, store=True) for m in models if m not in together]
    if together:
        try:
            parts.append(materialize(reduce(DataFrame.unionByName, [ahead(m, store=False) for m in together])))
        except (PySparkException, Py4JJavaError) as error:
            if strict or not _own(spark, error):
                raise
            parts += [ahead(m, store=True) for m in together]
    return reduce(DataFrame.unionByName, parts)
