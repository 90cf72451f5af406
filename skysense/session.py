"""Session helpers: one place that decides how lineage is cut and what may be broadcast."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_MAX_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Where it isn't set, a folder on the session's default file system is taken, next to
    the user's other files there. A cluster whose default file system is each machine's
    own must set it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        files = sc._jvm.org.apache.hadoop.fs.FileSystem.get(sc._jsc.hadoopConfiguration())
        home = files.getHomeDirectory()
        if files.getScheme() == "file" and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{home.toString().rstrip('/')}/.skysense/{sc.applicationId}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Store ``df`` as Parquet in the shared folder and continue from the stored rows.

    Used where a result feeds several branches of the next step: without it the
    branches would recompute everything upstream, doubling at every step. The stored
    table also survives lost executors, and later steps read only the columns they use.
    """
    spark = df.sparkSession
    path = new_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint a small table that was costly to make, such as one row per series."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_rows(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal columns where NULL equals NULL, so that rows with a NULL key find their partners.

    The columns of ``left`` come first, then the others of ``right``.
    """
    named = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_right_{c}`")) for c in on])
    return left.join(named, same, how).drop(*[f"_right_{c}" for c in on])


def attach(df: DataFrame, params: DataFrame, keys: tuple[str, ...], *,
           max_bytes: int = BROADCAST_MAX_BYTES, settled: bool = False) -> DataFrame:
    """Join per-series parameters onto the rows of each series (left join; NULL keys match).

    Without keys ``params`` is a single aggregate row and is broadcast. With keys it is
    stored and its size is taken from its row count and its columns: up to ``max_bytes``
    it is broadcast, so that the big side does not move. Beyond that both sides are
    shuffled by a plain join, whose hot keys adaptive execution splits by their actual
    sizes. ``settled`` says that ``params`` is stored already.
    """
    if not keys:
        return df.crossJoin(F.broadcast(params))
    if not settled:
        params = settle(params)
    if params.count() * row_bytes(params) <= max_bytes:
        params = F.broadcast(params)
    return join_rows(df, params, keys)


def row_bytes(df: DataFrame) -> int:
    """About how many bytes a row takes, by the types of its columns."""
    def width(kind: T.DataType) -> int:
        if isinstance(kind, T.StructType):
            return sum(width(f.dataType) for f in kind.fields)
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return 64
        return 64 + 8 * width(kind.elementType) if isinstance(kind, T.ArrayType) else 16

    return width(df.schema)
