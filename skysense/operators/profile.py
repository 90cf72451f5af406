"""Statistics and temporal patterns. Every operator aggregates all measures in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysense.constants import HISTOGRAM_BINS, IQR_K_CAP, IQR_K_REPORT, PERCENTILES
from skysense.functions import calendar
from skysense.functions.numeric import clip, coef_variation, pearson, sample_skewness, share_pct
from skysense.operators.outliers import count_outliers
from skysense.operators.quantiles import quantiles
from skysense.operators.relational import argmax, month_dim, weekday_dim
from skysense.operators.shapes import measure_order, per_measure
from skysense.session import attach, join_rows, settle


def nulls(m: str) -> Column:
    return F.count_if(F.col(m).isNull())


def rows() -> Column:
    return F.count(F.lit(1))


def missing_pct(m: str) -> Column:
    return share_pct(nulls(m), rows())


def _with_quantiles(stats: DataFrame, df: DataFrame, measures: Sequence[str], keys: tuple[str, ...],
                    named: dict[str, float], exact: bool = True) -> DataFrame:
    q = quantiles(df, measures, list(named.values()), keys, exact=exact)
    cols = [F.col("q")[i].alias(n) for i, n in enumerate(named)]
    return stats.join(q.select(*keys, "measure", *cols), [*keys, "measure"], "left")


def describe(df: DataFrame, measures: Sequence[str], keys: tuple[str, ...] = (), *, exact: bool = True) -> DataFrame:
    stats = per_measure(df, keys, measures, lambda m: {
        "count": F.count(m), "mean": F.avg(m), "std": F.stddev_samp(m),
        "min": F.min(m), "max": F.max(m), "missing_pct": missing_pct(m)})
    return _with_quantiles(stats, df, measures, keys, {"q25": 0.25, "median": 0.5, "q75": 0.75}, exact)


def quality_label(avg_missing: Column) -> Column:
    return F.when(avg_missing > 20, "Poor").when(avg_missing > 10, "Fair").otherwise("Good")


def measure_quality(missing: Column) -> Column:
    return F.when(missing < 5, "Good").when(missing < 15, "Fair").otherwise("Poor")


def upload_summary(df: DataFrame, measures: Sequence[str], ts: str = "datetime",
                   keys: tuple[str, ...] = ()) -> DataFrame:
    """Per measure: rows, time range, statistics, missing share (2 decimals) and quality labels."""
    stats = per_measure(df, keys, measures, lambda m: {
        "total_rows": rows(), "start": F.min(ts), "end": F.max(ts), "mean": F.avg(m),
        "std": F.stddev_samp(m), "min": F.min(m), "max": F.max(m), "missing_pct": F.round(missing_pct(m), 2)})
    full = _with_quantiles(stats, df, measures, keys, {"median": 0.5})
    # One row per measure is left of each series here.
    overall = quality_label(F.avg("missing_pct").over(Window.partitionBy(*keys)))
    return (full.withColumn("data_quality", overall)
            .withColumn("measure_quality", measure_quality(F.col("missing_pct"))))


def percentiles(df: DataFrame, measures: Sequence[str], keys: tuple[str, ...] = (),
                probs: Sequence[float] = PERCENTILES, *, exact: bool = True) -> DataFrame:
    q = quantiles(df, measures, probs, keys, exact=exact)
    labels = F.array(*[F.lit(round(p * 100)) for p in probs])
    pair = F.explode(F.arrays_zip(labels.alias("p"), F.col("q").alias("v"))).alias("r")
    return q.select(*keys, "measure", pair).select(
        *keys, "measure", F.col("r.p").cast("int").alias("percentile"), F.col("r.v").alias("value"))


def skewness(df: DataFrame, measures: Sequence[str], keys: tuple[str, ...] = ()) -> DataFrame:
    return per_measure(df, keys, measures, lambda m: {"skewness": sample_skewness(m)})


def coefficient_of_variation(df: DataFrame, measures: Sequence[str], keys: tuple[str, ...] = ()) -> DataFrame:
    return per_measure(df, keys, measures, lambda m: {"cv_pct": coef_variation(m)})


def histogram(df: DataFrame, measures: Sequence[str], keys: tuple[str, ...] = (),
              bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in ``bins`` equally wide bins between minimum and maximum; empty bins are left out.

    Bins are half-open except the last; a constant measure falls into bin 1.
    """
    by = (*keys, "measure")
    limits = settle(df.groupBy(*keys).agg(*[end(m).cast("double").alias(f"_{name}_{i}") for i, m in enumerate(measures)
                                            for name, end in (("lo", F.min), ("hi", F.max))]))
    # Limits meet the wide rows; only bin numbers are turned into rows, and counted at once.
    at = attach(df.select(*keys, *measures), limits, keys, settled=True)

    def number(m: str, i: int) -> Column:
        low, high, value = F.col(f"_lo_{i}"), F.col(f"_hi_{i}"), F.col(m).cast("double")
        share = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
        return F.when(value.isNotNull(), F.least(F.floor(share * bins) + 1, F.lit(bins)).cast("int")).alias(m)

    binned = at.select(*keys, *[number(m, i) for i, m in enumerate(measures)]).unpivot(list(keys), list(measures), "measure", "bin")
    counts = binned.filter(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    ends = limits.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(f"_lo_{i}").alias("_lo"), F.col(f"_hi_{i}").alias("_hi")) for i, m in enumerate(measures)])))
    counted = join_rows(counts, ends, by)
    width = (F.col("_hi") - F.col("_lo")) / bins
    return counted.select(*by, "bin", (F.col("_lo") + width * (F.col("bin") - 1)).alias("bin_start"),
                          (F.col("_lo") + width * F.col("bin")).alias("bin_end"), "n")


def box_stats(df: DataFrame, measures: Sequence[str], keys: tuple[str, ...] = (),
              k: float = IQR_K_REPORT) -> DataFrame:
    """Quartiles and whiskers, the extreme values within ``k`` quartile ranges of the box."""
    by = (*keys, "measure")
    q = quantiles(df, measures, [0.25, 0.5, 0.75], keys).select(
        *by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    fences = settle(q.select(*by, (F.col("q1") - k * iqr).alias("_low"), (F.col("q3") + k * iqr).alias("_high"), "q1", "median", "q3"))
    # One row per series with the fences of all measures; readings stay wide.
    wide = fences.groupBy(*keys).agg(*[F.max_by(F.struct("_low", "_high"), F.col("measure") == m).alias(f"_{i}") for i, m in enumerate(measures)])
    at = attach(df.select(*keys, *measures), wide, keys)

    def whiskers(m: str) -> dict[str, Column]:
        value, f = F.col(m).cast("double"), f"_{list(measures).index(m)}"
        low, high = F.col(f"{f}._low"), F.col(f"{f}._high")
        inside = F.when((value >= low) & (value <= high), value)
        return {"whisker_low": F.min(inside), "whisker_high": F.max(inside), "outside": F.count_if((value < low) | (value > high)),
                "_n": F.count(value)}

    found = per_measure(at, keys, measures, whiskers).filter("_n > 0")
    return join_rows(found, fences, by).select(*by, "q1", "median", "q3", "whisker_low", "whisker_high", "outside")


def corr_matrix(df: DataFrame, measures: Sequence[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Pearson correlation of every pair of measures over rows that have both."""
    pairs = [(a, b) for i, a in enumerate(measures) for b in measures[i + 1:]]
    wide = df.groupBy(*keys).agg(*[pearson(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("measure_1"), F.lit(b).alias("measure_2"), F.col(f"_r{i}").alias("corr"))
                      for i, (a, b) in enumerate(pairs)])
    return wide.select(*keys, F.inline(items))


def strong_corr(df: DataFrame, measures: Sequence[str], keys: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    size = F.abs("corr")
    strength = F.when(size > 0.8, "Very Strong").when(size > 0.6, "Strong").otherwise("Moderate")
    return (corr_matrix(df, measures, keys).filter(size > threshold)
            .withColumn("strength", strength)
            .withColumn("direction", F.when(F.col("corr") > 0, "Positive").otherwise("Negative")))


def hourly_pattern(df: DataFrame, measures: Sequence[str], ts: str = "datetime", keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, deviation and mean ± deviation by hour of day."""
    by_hour = per_measure(df.withColumn("hour", calendar.hour(ts)), (*keys, "hour"), measures,
                          lambda m: {"mean": F.avg(m), "std": F.stddev_samp(m)})
    return (by_hour.withColumn("lower", F.col("mean") - F.col("std"))
            .withColumn("upper", F.col("mean") + F.col("std")))


def peak_hours(df: DataFrame, measures: Sequence[str], ts: str = "datetime", keys: tuple[str, ...] = ()) -> DataFrame:
    """Hours with the highest and lowest mean, and how far apart they are."""
    by = (*keys, "measure")
    peaks = hourly_pattern(df, measures, ts, keys).groupBy(*by).agg(
        argmax("hour", F.col("mean")).alias("peak_hour"), F.max("mean").alias("peak_mean"),
        argmax("hour", -F.col("mean")).alias("low_hour"), F.min("mean").alias("low_mean"))
    change = F.try_divide(F.col("peak_mean") - F.col("low_mean"), F.col("low_mean")) * 100
    return peaks.withColumn("peak_to_low_pct", change)


def top_measures(df: DataFrame, measures: Sequence[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Measure with the highest mean and measure with the highest deviation."""
    stats = per_measure(df, keys, measures, lambda m: {"mean": F.avg(m), "std": F.stddev_samp(m)})
    rank = -measure_order(measures)

    def best(stat: str) -> Column:
        return F.max_by("measure", F.when(F.col(stat).isNotNull(), F.struct(F.col(stat), rank)))

    return stats.groupBy(*keys).agg(best("mean").alias("highest_measure"), F.max("mean").alias("highest_mean"),
                                    best("std").alias("most_variable"), F.max("std").alias("highest_std"))


def weekday_pattern(df: DataFrame, measures: Sequence[str], ts: str = "datetime") -> DataFrame:
    """Mean by weekday in Monday-to-Sunday order; a weekday without data has NULLs."""
    by_day = df.groupBy(calendar.weekday_name(ts).alias("weekday")).agg(*[F.avg(m).alias(m) for m in measures])
    return weekday_dim(by_day)


def monthly_pattern(df: DataFrame, measures: Sequence[str], ts: str = "datetime", min_months: int = 4) -> DataFrame:
    """Mean by calendar month, only if at least ``min_months`` different months occur."""
    by_month = df.groupBy(calendar.month_name(ts).alias("month")).agg(*[F.avg(m).alias(m) for m in measures])
    seen = F.count("month").over(Window.partitionBy())  # over at most 12 rows
    return (month_dim(by_month).withColumn("_months", seen)
            .filter(F.col("_months") >= min_months).drop("_months"))


def weekend_compare(df: DataFrame, measures: Sequence[str], ts: str = "datetime", keys: tuple[str, ...] = ()) -> DataFrame:
    weekend = F.weekday(ts) >= 5
    means = per_measure(df, keys, measures, lambda m: {
        "weekday_mean": F.avg(F.when(~weekend, F.col(m))), "weekend_mean": F.avg(F.when(weekend, F.col(m)))})
    diff = F.try_divide(F.col("weekend_mean") - F.col("weekday_mean"), F.col("weekday_mean")) * 100
    return means.withColumn("difference_pct", diff)


def missing_profile(df: DataFrame, columns: Sequence[str], keys: tuple[str, ...] = ()) -> DataFrame:
    return per_measure(df, keys, columns, lambda c: {"missing": nulls(c), "missing_pct": missing_pct(c)})


def completeness(df: DataFrame, columns: Sequence[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of cells that hold a value, with a grade."""
    missing = sum((nulls(c) for c in columns[1:]), nulls(columns[0]))
    out = df.groupBy(*keys).agg(rows().alias("rows"), missing.alias("missing"))
    cells = F.col("rows") * len(columns)
    out = out.withColumn("completeness_pct", share_pct(cells - F.col("missing"), cells))
    grade = (F.when(F.col("completeness_pct") >= 95, "Excellent")
             .when(F.col("completeness_pct") >= 85, "Good").otherwise("Concerns"))
    return out.withColumn("grade", F.when(F.col("completeness_pct").isNotNull(), grade))


def time_coverage(df: DataFrame, ts: str = "datetime", keys: tuple[str, ...] = ()) -> DataFrame:
    """First and last time, and the whole days of 24 hours between them."""
    out = df.groupBy(*keys).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), rows().alias("points"))
    span = F.floor((F.unix_timestamp("end") - F.unix_timestamp("start")) / 86400).cast("long")
    return out.withColumn("span_days", span)


def quality_score(df: DataFrame, measures: Sequence[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Per measure a score of 0-100 from completeness, outliers and variability, and the overall band.

    The overall score is the mean of the scores rounded to one decimal.
    """
    by = [*keys, "measure"]
    base = per_measure(df, keys, measures, lambda m: {"missing_pct": missing_pct(m), "cv_pct": coef_variation(m)})
    out = base.join(count_outliers(df, measures, keys, k=IQR_K_CAP).select(*by, "outlier_pct"), by)
    zero, hundred = F.lit(0.0), F.lit(100.0)
    complete = hundred - F.col("missing_pct")
    few_outliers = clip(hundred - F.col("outlier_pct") * 5, lower=zero)
    consistent = clip(hundred - clip(F.col("cv_pct"), upper=hundred), lower=zero)
    scored = out.withColumn("completeness", complete).withColumn(
        "score", complete * 0.5 + few_outliers * 0.3 + consistent * 0.2)
    joined = scored.withColumn("overall_score", F.avg(F.round("score", 1)).over(Window.partitionBy(*keys)))
    band = (F.when(F.col("overall_score") >= 90, "Excellent").when(F.col("overall_score") >= 75, "Good")
            .when(F.col("overall_score") >= 60, "Fair").otherwise("Poor"))
    return joined.withColumn("overall_band", band)


def statistics(df: DataFrame, measures: Sequence[str], ts: str = "datetime", keys: tuple[str, ...] = ()) -> DataFrame:
    """Flat statistics table: one row per measure with ranges, statistics and quality metrics."""
    by = [*keys, "measure"]
    base = per_measure(df, keys, measures, lambda m: {
        "total_rows": rows(), "start": F.min(ts), "end": F.max(ts), "count": F.count(m), "mean": F.avg(m),
        "std": F.stddev_samp(m), "min": F.min(m), "max": F.max(m), "missing_count": nulls(m),
        "missing_pct": missing_pct(m), "cv_pct": coef_variation(m)})
    base = _with_quantiles(base, df, measures, keys, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    span = F.floor((F.unix_timestamp("end") - F.unix_timestamp("start")) / 86400).cast("long")
    return (base.join(count_outliers(df, measures, keys), by)
            .withColumn("span_days", span).withColumn("completeness", F.lit(100.0) - F.col("missing_pct")))


def statistics_json(df: DataFrame, measures: Sequence[str], ts: str = "datetime", keys: tuple[str, ...] = ()) -> DataFrame:
    """The statistics as one nested JSON document per series; entries per document = number of measures."""
    flat = statistics(df, measures, ts, keys)
    order = measure_order(measures)
    stats = F.struct("count", "mean", "std", "min", "q25", "median", "q75", "max", "missing_count", "missing_pct")
    quality = F.struct("completeness", "outliers", "outlier_pct", "cv_pct")

    def by_measure(value: Column) -> Column:
        entries = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("measure").alias("k"), value.alias("v"))))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"], e["v"])))

    nested = flat.groupBy(*keys).agg(
        F.struct(F.max("total_rows").alias("total_rows"), F.count(F.lit(1)).alias("measures")).alias("metadata"),
        F.struct(F.min("start").alias("start"), F.max("end").alias("end"),
                 F.max("span_days").alias("span_days")).alias("time_range"),
        by_measure(stats).alias("measure_statistics"), by_measure(quality).alias("quality_metrics"))
    body = ["metadata", "time_range", "measure_statistics", "quality_metrics"]
    return nested.select(*keys, F.to_json(F.struct(*body)).alias("document"))
