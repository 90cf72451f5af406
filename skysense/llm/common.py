"""What the operators share: stored tables, row locators, joins on a checked size, files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A stored side of a join is broadcast up to this many bytes, and shuffled beyond.
BROADCAST_BYTES = 48 << 20
#: Texts are handed to vectorised code in slices of about so many bytes.
SLICE_BYTES = 1 << 20

#: Steps of a plan that give at most one row for each of theirs, the same when run again.
ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias", "View", "Sort", "Repartition", "RepartitionByExpression"}

#: Where a row lies: the file and the row's number in it.
FILE, ROW = "__file", "__row"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # A local master has one machine, and its warehouse lies there.
        shared = spark.conf.get("spark.sql.warehouse.dir") + "/llm-stages"
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once, cut its lineage and go on from the written rows."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this package wrote."""
    fs, hadoop = _hadoop(spark, path)
    fs.delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _hadoop(spark, path)
    return fs.exists(hadoop)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, as a mark that something is done."""
    fs, hadoop = _hadoop(spark, path)
    fs.create(hadoop, True).close()


def straight(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is another row of files: nothing above the scan makes several of one."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ROW_BY_ROW:
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() == "LogicalRelation"


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with the file and row number of each row, which stay the same when read again.

    A table that doesn't come straight from files is written first.
    """
    where = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW)]
    if "_metadata" not in docs.columns and straight(docs):
        try:
            return docs.select("*", *where)
        except AnalysisException:
            pass
    return stored(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), "located").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], *where)


def hinted(side: DataFrame, row_bytes: int) -> DataFrame:
    """``side`` (a stored table), to be broadcast if its rows are few enough."""
    return F.broadcast(side) if side.count() * row_bytes <= BROADCAST_BYTES else side


def rows_at(docs: DataFrame, wanted: DataFrame, others: DataFrame) -> DataFrame:
    """The rows of the located ``docs`` at the places in ``wanted``.

    ``others`` are all other places. The shorter of the two stored lists is joined, as
    a broadcast if it is small, else by shuffling.
    """
    n, m = wanted.count(), others.count()
    side, how = (wanted, "left_semi") if n <= m else (others, "left_anti")
    side = side.select(FILE, ROW)
    if min(n, m) * 200 <= BROADCAST_BYTES:
        side = F.broadcast(side)
    return docs.join(side, [FILE, ROW], how)


def slices(texts: pa.StringArray | pa.LargeStringArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``texts`` with about ``most`` bytes each; a longer text is alone."""
    import numpy as np

    if not len(texts):
        return
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(texts):
        stop = int(max(np.searchsorted(ends, done + most, side="right"), start + 1))
        yield start, stop
        start, done = stop, int(ends[stop - 1])


def open_output(uri: str):
    """A stream to write the file at ``uri``, on whatever store the URI names."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def open_input(uri: str):
    fs, path = file_system(uri)
    return fs.open_input_file(path)


def file_system(uri: str):
    import re

    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:/*", "", uri)
    if ":/" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
