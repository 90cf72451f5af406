"""Readings tables: from files, and derived from the event and order-line tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysense.constants import META_COLUMNS, MEASURES
from skysense.functions.numeric import nan_to_null

# Which event type stands for which measure; the sixth measure has no events on purpose.
EVENT_MEASURES = {"click": "pm2_5", "view": "pm10", "purchase": "no2", "signup": "so2", "error": "co"}
HOURLY = tuple(EVENT_MEASURES.values())
DAILY = ("quantity", "price", "discount", "tax")
STATIONS = 4


def scan_readings(spark: SparkSession, path: str, *, fmt: str | None = None, ts: str = "datetime",
                  schema: T.StructType | str | None = None) -> DataFrame:
    """Read a readings file or folder (CSV or Parquet) with a time column.

    Text times become TIMESTAMP_NTZ, NaN becomes NULL. For CSV pass ``schema`` at
    scale; otherwise types are inferred in an extra pass over the file.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    if fmt == "csv":
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    return normalise(df, ts)


def normalise(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Time column to TIMESTAMP_NTZ, NaN to NULL."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == ts and not isinstance(f.dataType, T.TimestampNTZType):
            c = F.to_timestamp_ntz(c) if isinstance(f.dataType, T.StringType) else c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


class Checked(NamedTuple):
    """A scan that keeps what it couldn't read."""

    rows: DataFrame  # typed columns, and ``problems`` per row
    counts: Observation  # rows, bad_lines and bad_cells of the first action on ``rows``

    @property
    def data(self) -> DataFrame:
        return self.rows.drop("problems")

    @property
    def problems(self) -> DataFrame:
        """One row per cell or line that couldn't be read: ``reason``, ``column``, ``found``."""
        return self.rows.select(F.inline("problems"))


def scan_checked(spark: SparkSession, path: str, schema: T.StructType | str, *, ts: str = "datetime", header: bool = True) -> Checked:
    """Read a CSV file or folder with a given schema and say what isn't as the schema has it.

    A cell that its type can't hold becomes NULL and is reported with its column and text; an
    empty cell is only missing. A line with too many or too few cells is reported whole, and
    its cells stay as far as they go. Counts come with the first pass over ``rows``. A header
    with other names or another order is an error.
    """
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    taken = {"problems", "_line"} & set(kinds.fieldNames())
    if taken:
        raise ValueError(f"columns {sorted(taken)} have names that the scan uses")
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in kinds] + [T.StructField("_line", T.StringType())])
    # With pruned columns Spark doesn't see lines of the wrong length.
    raw = (spark.read.schema(texts).option("header", header).option("enforceSchema", not header).option("columnPruning", False)
           .option("columnNameOfCorruptRecord", "_line").option("mode", "PERMISSIVE").csv(path))

    def typed(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if f.name == ts:
            return F.try_to_timestamp(c).cast("timestamp_ntz")
        return nan_to_null(c.try_cast(f.dataType)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.try_cast(f.dataType)

    def problem(reason: str, column: Column, found: Column) -> Column:
        return F.struct(F.lit(reason).alias("reason"), column.cast("string").alias("column"), found.alias("found"))

    def unread(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        kept = F.try_to_timestamp(c) if f.name == ts else c.try_cast(f.dataType)
        return F.when((F.trim(c) != "") & kept.isNull(), problem("cell", F.lit(f.name), c))

    found = F.array_compact(F.array(F.when(F.col("_line").isNotNull(), problem("line", F.lit(None), F.col("_line"))),
                                    *[unread(f) for f in kinds]))
    counts = Observation()
    rows = raw.select(*[typed(f).alias(f.name) for f in kinds], found.alias("problems"))
    return Checked(rows.observe(counts, F.count(F.lit(1)).alias("rows"), count_problems("problems", "line").alias("bad_lines"),
                                count_problems("problems", "cell").alias("bad_cells")), counts)


def count_problems(problems: str, reason: str, column: str | None = None) -> Column:
    """How many problems of a kind the rows of a checked scan have, as an aggregate."""
    def of_kind(p: Column) -> Column:
        return (p["reason"] == reason) & (F.lit(True) if column is None else p["column"] == column)

    return F.coalesce(F.sum(F.size(F.filter(problems, of_kind))), F.lit(0))


def project_measures(df: DataFrame, ts: str = "datetime", measures: Sequence[str] = MEASURES,
                     meta: Sequence[str] = META_COLUMNS) -> DataFrame:
    """Time, the measures that exist, and the descriptive columns that exist."""
    return df.select(ts, *[c for c in (*measures, *meta) if c in df.columns])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event: station, hour, event id and the value under its measure's name."""
    e = table(spark, folder, "events").withColumn("value", nan_to_null("value"))
    return e.select(
        (F.col("user_id") % STATIONS).alias("station"),
        F.window("ts", "1 hour")["start"].alias("datetime"),
        "event_id",
        *[F.when(F.col("event_type") == t, F.col("value")).alias(m) for t, m in EVENT_MEASURES.items()])


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """One row per station and hour with an event; mean per measure, NULL without events."""
    return event_rows(spark, folder).groupBy("station", "datetime").agg(
        *[F.round(F.avg(m), 6).alias(m) for m in HOURLY])


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """One row per supplier and ship date; means of the four line figures."""
    li = table(spark, folder, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("station"), F.col("l_shipdate").alias("datetime")).agg(
        F.round(F.avg("l_quantity"), 6).alias("quantity"),
        F.round(F.avg("l_extendedprice"), 6).alias("price"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
        F.round(F.avg("l_tax"), 6).alias("tax"))
