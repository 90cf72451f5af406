"""Writing cleaned readings, exports and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysense.constants import MEASURE_LABELS

MAX_RECORDS_PER_FILE = 5_000_000


def write_readings(df: DataFrame, path: str, *, fmt: str = "parquet", keys: Sequence[str] = ("station",),
                   ts: str = "datetime", partitioned: bool = True, replace: bool = False) -> str:
    """Write readings under ``path``; Parquet by day, so readers can skip folders.

    Rows are sent to tasks by day before writing, which keeps the number of files low; the
    rebalance hint lets adaptive execution split a day that is too big for one task. Within
    a file rows are in the order of series and time, so readers skip by series as well.

    What is there already is an error. With ``replace`` the days that ``df`` has are written
    anew and all others stay, so that a run that comes again leaves the same rows.
    """
    if replace and not partitioned:
        raise ValueError("only readings by day can be replaced by day")
    writer_input, by = df, []
    if partitioned:
        writer_input = df.withColumn("date", F.to_date(ts)).hint("rebalance", "date").sortWithinPartitions("date", *keys, ts)
        by = ["date"]
    mode = "overwrite" if replace else "errorifexists"
    writer = writer_input.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    if by:
        writer = writer.partitionBy(*by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def read_back(spark: SparkSession, path: str, like: DataFrame, *, fmt: str = "parquet") -> DataFrame:
    """Read what ``write_readings`` wrote, with the columns and types of ``like``."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).schema(like.schema)
    df = reader.load(path)
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in like.schema.fields])


def with_labels(df: DataFrame) -> DataFrame:
    """Measure columns under the names shown to users, as exports have them."""
    return df.withColumnsRenamed({m: label for m, label in MEASURE_LABELS.items() if m in df.columns})


def from_labels(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({label: m for m, label in MEASURE_LABELS.items() if label in df.columns})


def export_csv(df: DataFrame, path: str) -> str:
    return write_readings(with_labels(df), path, fmt="csv", partitioned=False)


def export_json(df: DataFrame, path: str) -> str:
    """One JSON document per line from a ``document`` column."""
    df.select(F.col("document").alias("value")).write.mode("errorifexists").text(path)
    return path
