"""Report tables: before/after comparison, cleaning report, analysis report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysense.constants import MISSING_CAUTION, QUALITY_ADVICE
from skysense.operators import profile
from skysense.operators.schema import missing_share


def _side(df: DataFrame, label: str, ts: str) -> DataFrame:
    cols = df.columns
    gone = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in cols[1:]), F.count_if(F.col(f"`{cols[0]}`").isNull()))
    return df.agg(F.count(F.lit(1)).alias("rows"), gone.alias("missing"), missing_share(cols).alias("missing_pct"),
                  F.min(ts).alias("start"), F.max(ts).alias("end")).select(
        F.lit(label).alias("stage"), "rows", F.lit(len(cols)).alias("columns"), "missing", "missing_pct", "start", "end")


def before_after(raw: DataFrame, clean: DataFrame, ts: str = "datetime") -> DataFrame:
    """One row per stage with size, missing values and time range, and the change in rows."""
    both = _side(raw, "before", ts).unionByName(_side(clean, "after", ts))
    signed = F.when(F.col("stage") == "after", F.col("rows")).otherwise(-F.col("rows"))
    return both.withColumn("row_change", F.sum(signed).over(Window.partitionBy()))  # two rows


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _items(df: DataFrame, section: str, order: int, items: dict[str, Column], prefix: Column | None = None) -> DataFrame:
    cells = [F.struct((F.concat(prefix, F.lit(f".{k}")) if prefix is not None else F.lit(k)).alias("item"),
                      _text(v).alias("value")) for k, v in items.items()]
    return df.select(F.lit(order).alias("section_no"), F.lit(section).alias("section"), F.inline(F.array(*cells)))


def cleaning_report(raw: DataFrame, clean: DataFrame, log: DataFrame, ts: str = "datetime") -> DataFrame:
    """Long table (section_no, section, item, value)."""
    both = before_after(raw, clean, ts)
    facts = {"total_rows": F.col("rows"), "total_columns": F.col("columns"), "missing_values": F.col("missing"),
             "missing_pct": F.round("missing_pct", 2), "start": F.col("start"), "end": F.col("end")}
    before = _items(both.filter(F.col("stage") == "before"), "original", 1, facts)
    after = _items(both.filter(F.col("stage") == "after"), "cleaned", 2, facts)
    actions = log.select(F.lit(3).alias("section_no"), F.lit("actions").alias("section"),
                         F.concat_ws(".", "step", "action", "detail").alias("item"), _text("n").alias("value"))
    summary = _items(both.filter(F.col("stage") == "after"), "summary", 4,
                     {"row_change": F.col("row_change"), "columns_retained": F.col("columns")})
    return before.unionByName(after).unionByName(actions).unionByName(summary)


def analysis_report(df: DataFrame, measures: Sequence[str], ts: str = "datetime") -> DataFrame:
    """Long table (section_no, section, item, value) with overview, statistics, quality,
    insights and recommendations over the whole table."""
    summary = profile.upload_summary(df, measures, ts)
    top = profile.top_measures(df, measures)
    overall = summary.groupBy().agg(
        F.max("total_rows").alias("total_rows"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.max("data_quality").alias("data_quality"), F.count(F.lit(1)).alias("measures"),
        F.avg("missing_pct").alias("avg_missing"))
    overview = _items(overall, "overview", 1, {
        "total_records": F.col("total_rows"), "start": F.date_format("start", "yyyy-MM-dd HH:mm"),
        "end": F.date_format("end", "yyyy-MM-dd HH:mm"), "data_quality": F.col("data_quality"),
        "measures": F.col("measures")})

    def two(c: str) -> Column:
        return F.col(c).cast("decimal(20,2)")

    name = F.col("measure")
    stats = _items(summary, "statistics", 2, {c: two(c) for c in ("mean", "std", "min", "max", "median")}, name)
    quality = _items(summary, "quality", 3, {"status": F.col("measure_quality"), "missing_pct": two("missing_pct")}, name)
    insights = _items(top, "insights", 4, {
        "highest_average": F.col("highest_measure"), "most_variable": F.col("most_variable")})
    complete = _items(overall, "insights", 4, {"avg_completeness": (100 - F.col("avg_missing")).cast("decimal(20,1)")})
    advice = F.coalesce(*[F.when(F.col("data_quality") == label, text) for label, text in QUALITY_ADVICE.items()])
    caution = F.when(F.col("avg_missing") > 10, MISSING_CAUTION)
    recommend = _items(overall, "recommendations", 5, {"quality": advice, "missing": caution}).filter(
        F.col("value").isNotNull())
    return overview.unionByName(stats).unionByName(quality).unionByName(insights).unionByName(complete).unionByName(recommend)
