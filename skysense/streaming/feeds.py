"""Streaming twins of the batch operators, over a folder of event files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skysense.constants import AQI_ALERT_THRESHOLD
from skysense.functions.aqi import is_alert
from skysense.operators.air import with_aqi
from skysense.session import new_path
from skysense.sources.readings import EVENT_MEASURES, STATIONS

WATERMARK = "2 hours"


def event_stream(spark: SparkSession, folder: str, *, files_per_batch: int = 1000) -> DataFrame:
    """Events as a stream. Times are cast to TIMESTAMP because a watermark needs it;
    with the session time zone set to UTC the values do not change."""
    # Reading the schema fails where the table is missing. As a pattern the same path may be
    # one file or a folder of part files; a plain one must be a folder.
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/events.{{parquet}}")
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                      (F.col("user_id") % STATIONS).alias("station"), "event_type", "value")


def hour_of(ts: str) -> Column:
    return F.date_trunc("hour", ts)


def hourly_means(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Mean per station, measure and hour; a window is emitted once the watermark has passed it."""
    means = (events.withWatermark("ts", watermark)
             .groupBy("station", F.window("ts", "1 hour"))
             .agg(*[F.round(F.avg(F.when(F.col("event_type") == t, F.col("value"))), 6).alias(m)
                    for t, m in EVENT_MEASURES.items()]))
    return means.select("station", F.col("window.start").cast("timestamp_ntz").alias("datetime"),
                        *EVENT_MEASURES.values())


def hourly_aqi_alerts(events: DataFrame, threshold: int = AQI_ALERT_THRESHOLD, watermark: str = WATERMARK) -> DataFrame:
    """Hourly index per station, only hours above the threshold; columns only, so the
    same code serves stream and batch."""
    return with_aqi(hourly_means(events, watermark)).filter(is_alert(F.col("aqi"), threshold))


def dedupe(events: DataFrame, keys: tuple[str, ...] = ("station", "ts"), watermark: str = WATERMARK) -> DataFrame:
    """First arrival per key, with all its columns; state older than the watermark is dropped."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def first_events(events: DataFrame, keys: tuple[str, ...] = ("station", "event_type"), order: tuple[str, ...] = ("ts", "event_id"),
                 length: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Per key and stretch of time the first event by ``order``, with all its columns.

    Unlike ``dedupe`` the result doesn't depend on arrival: the state of a key is the whole row
    with the smallest order so far, and the row is emitted once the watermark has passed its
    stretch. NULL sorts first.
    """
    first = F.min_by(F.struct(*events.columns), F.struct(*order)).alias("first")
    kept = events.withWatermark("ts", watermark).groupBy(*keys, F.window("ts", length)).agg(first)
    return kept.select("first.*", F.col("window.start").cast("timestamp_ntz").alias("window_start"))


def sliding_means(events: DataFrame, length: str = "24 hours", slide: str = "1 hour",
                  watermark: str = WATERMARK) -> DataFrame:
    """Rolling mean over time per station and event type. Frames are stretches of time,
    not numbers of rows, and include incomplete ones at the start.

    Events are summed per ``slide`` first; only these few sums enter the overlapping frames.
    """
    steps = (events.withWatermark("ts", watermark)
             .groupBy("station", "event_type", F.window("ts", slide).alias("step"))
             .agg(F.sum("value").alias("total"), F.count("value").alias("values"), F.count(F.lit(1)).alias("n")))
    frames = (steps.groupBy("station", "event_type", F.window(F.window_time("step"), length, slide))
              .agg(F.try_divide(F.sum("total"), F.sum("values")).alias("mean"), F.sum("n").alias("n")))
    return frames.select("station", "event_type", F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                         F.col("window.end").cast("timestamp_ntz").alias("window_end"), "mean", "n")


def start(stream: DataFrame, name: str, path: str, state: str, trigger: str = "1 minute") -> StreamingQuery:
    """Keep writing ``stream`` to Parquet files under ``path``; ``state`` holds its progress.

    Started again with the same folders it goes on after the last finished batch.
    """
    return (stream.writeStream.queryName(name).format("parquet").outputMode("append")
            .option("checkpointLocation", state).trigger(processingTime=trigger).start(path))


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process everything that is there now into Parquet files and return them as a table.

    Output and stream checkpoint lie in the shared folder, so a restarted query goes on
    from the last finished batch.
    """
    spark = stream.sparkSession
    base = new_path(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
