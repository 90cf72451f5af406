"""Exact deduplication with keyed state that never expires.

Every row enters a stream as digest, identifier and content locator (file and row number);
the texts stay where they are. The stream keeps one entry per digest, on disk in RocksDB
and in its checkpoint: the first identifier, its locator and the number of rows so far.
Entries never expire, so rows of a later run meet those of all earlier runs. What the
stream reports as a hit is then checked over its full bytes, read through the locators;
texts that share a digest without being equal are told apart there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysense.llm.common import FILE, ROW, drop_folder, exists, located, new_folder, rows_at, stored, touch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: RocksDB shares one memory bound, and doesn't reserve disk for its log files ahead of their use.
ROCKSDB_OPTIONS = {"spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
                   "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}

#: Rows order by known identifiers first, then by identifier, then by place.
_PLACE = "struct(`__id` IS NULL AS unknown, `__id` AS id, `__file` AS file, `__row` AS row)"
INTAKE = T.StructType([
    T.StructField("__id", T.LongType()), T.StructField("__digest", T.BinaryType()),
    T.StructField(FILE, T.StringType()), T.StructField(ROW, T.LongType())])


def normalised(text: Column) -> Column:
    """Runs of white space as one space; NULL as the empty text. Single spaces aren't touched."""
    run = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), run, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class Deduplicator:
    """State of all runs so far below ``folder``: intake, checkpoint and ledger.

    ``add`` takes a further table, ``verdicts`` tells of all rows so far. Each table is a
    batch with a name, by default a hash of its files and of the plan over them. A batch
    that was taken in before is not taken again, so an ``add`` that failed on the way, or
    was repeated, does no harm: the checkpoint knows what the state has seen. Hits are
    checked on full texts, so an object that goes on from another's folder needs the
    tables of earlier batches too: ``add`` them again or ``attach`` them.
    """

    def __init__(self, spark: SparkSession, folder: str, *, digest: Callable[[Column], Column] = sha256,
                 normal: Callable[[Column], Column] = normalised, files_per_batch: int = 100_000):
        self.spark, self.folder = spark, folder
        self.digest, self.normal, self.files_per_batch = digest, normal, files_per_batch
        self.docs: dict[str, DataFrame] = {}

    def attach(self, docs: DataFrame, key: str = "doc_id", text: str = "text", batch: str | None = None) -> str:
        """Make the texts of a table readable without taking it in; returns the batch's name."""
        rows = located(docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text")))
        if batch is None:
            plan = rows._jdf.queryExecution().analyzed().canonicalized().treeString()
            batch = hashlib.sha256("\n".join([plan, *sorted(rows.inputFiles())]).encode()).hexdigest()[:32]
        self.docs[batch] = rows
        return batch

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text", batch: str | None = None) -> None:
        batch = self.attach(docs, key, text, batch)
        done = f"{self.folder}/taken/{batch}"
        if not exists(self.spark, done):
            (self.docs[batch].select("__id", self.digest(self.normal(F.col("__text"))).alias("__digest"), FILE, ROW)
             .write.mode("overwrite").parquet(f"{self.folder}/intake/{batch}"))
            # The stream runs only after this, so it never sees half an intake.
            touch(self.spark, done)
        self._run()

    def _run(self) -> None:
        spark = self.spark
        state = (spark.readStream.schema(INTAKE).option("maxFilesPerTrigger", self.files_per_batch)
                 .parquet(f"{self.folder}/intake/*").groupBy("__digest")
                 .agg(F.expr(f"min({_PLACE})").alias("keep"), F.count(F.lit(1)).alias("rows")))

        def save(batch: DataFrame, number: int) -> None:
            # The same batch may come again after a failure; it then replaces itself.
            batch.write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={number}")

        options = {PROVIDER: ROCKSDB, **ROCKSDB_OPTIONS}
        before = {k: spark.conf.get(k, None) for k in options}
        for k, v in options.items():
            spark.conf.set(k, v)
        try:
            query = (state.writeStream.outputMode("update").foreachBatch(save)
                     .option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start())
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def intake(self) -> DataFrame:
        return self.spark.read.schema(INTAKE).parquet(f"{self.folder}/intake/*")

    def ledger(self) -> DataFrame:
        """The newest entry of each digest: first rows only get smaller, counts only grow."""
        return (self.spark.read.option("basePath", f"{self.folder}/ledger").parquet(f"{self.folder}/ledger")
                .groupBy("__digest").agg(F.min("keep").alias("keep"), F.max("rows").alias("rows")))

    def verdicts(self) -> DataFrame:
        """Per row of all tables: ``__id``, place, ``__digest``, ``keep`` (place of the row that stays), ``rows``."""
        entries = stored(self.ledger(), "ledger")
        judged = stored(self.intake().join(entries, "__digest"), "verdicts")
        hits = judged.filter(F.col("rows") > 1)
        if not judged.isEmpty():
            clashing = self._clashes(hits.select(FILE, ROW, "__digest"), judged)
            if not clashing.isEmpty():
                fixed = self._settle(clashing, judged)
                judged = (judged.join(fixed.select(FILE, ROW), [FILE, ROW], "left_anti")
                          .unionByName(fixed.select(*judged.columns)))
        return judged

    def _texts(self, places: DataFrame, others: DataFrame) -> DataFrame:
        """Normalised texts at ``places``, read through the locators, with their digests."""
        parts = [rows_at(d, places, others).select(FILE, ROW, "__id", self.normal(F.col("__text")).alias("__text"))
                 for d in self.docs.values()]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.withColumn("__digest", self.digest(F.col("__text")))

    def _clashes(self, places: DataFrame, judged: DataFrame) -> DataFrame:
        """Digests whose rows aren't all the same bytes. Smallest and largest text are compared
        after map-side aggregation, so that a text travels once per task, however often it occurs."""
        others = judged.filter(F.col("rows") == 1).select(FILE, ROW)
        ends = self._texts(places, others).groupBy("__digest").agg(
            F.min("__text").alias("a"), F.max("__text").alias("b"), F.count(F.lit(1)).alias("read"))
        seen = stored(ends.select("__digest", (F.col("a") != F.col("b")).alias("differ"), "read"), "hits")
        if (seen.agg(F.sum("read")).first()[0] or 0) < places.count():
            raise ValueError("texts of an earlier batch can't be read: attach its table first")
        return seen.filter("differ").select("__digest")

    def _settle(self, clashing: DataFrame, judged: DataFrame) -> DataFrame:
        """Rows with a clashing digest, grouped by their full texts."""
        mine = stored(judged.join(clashing, "__digest", "left_semi").select(FILE, ROW), "clashing")
        others = judged.join(clashing, "__digest", "left_anti").select(FILE, ROW)
        texts = self._texts(mine, others)
        groups = texts.groupBy("__text").agg(F.expr(f"min({_PLACE})").alias("keep"), F.count(F.lit(1)).alias("rows"))
        return stored(texts.join(groups, "__text").drop("__text"), "settled")

    def close(self) -> None:
        drop_folder(self.spark, self.folder)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, and the place.

    Of equal texts the row with the smallest identifier stays; a NULL identifier comes
    after all others, and rows that repeat an identifier are told apart by their place,
    so exactly one row of a group stays. A NULL text equals the empty one. Other columns
    of ``docs`` take no part. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    runs = Deduplicator(spark, new_folder(spark, "dedup"), **options)
    runs.add(docs, key, text)
    kept = (F.col("keep.file") == F.col(FILE)) & (F.col("keep.row") == F.col(ROW))
    return runs.verdicts().select(
        F.col("__id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("rows").alias("group_size"),
        kept.alias("kept"), F.lower(F.hex("__digest")).alias("text_sha256"), FILE, ROW)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    names = docs.columns
    rows = located(docs)
    verdict = stored(dedup(rows.select(*[F.col(c) for c in names]), key, text).select(FILE, ROW, "kept"), "kept")
    return rows_at(rows, verdict.filter("kept"), verdict.filter("NOT kept")).select(*names)


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)"""
