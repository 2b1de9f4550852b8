"""Structured Streaming: event-time timelines with late data, and incremental loading by micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.sources.store import Store, ensure_checkpoint_dir


def events_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """The event files of a directory as a stream, with a real timestamp column (watermarks need one)."""
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(p):  # a single file: its directory, and only this name in it
        folder, _, name = path.rpartition("/")
        reader, path = reader.option("pathGlobFilter", name), folder
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Events, value and approximate users by tumbling or sliding window and type; what comes later than the watermark is left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Events of a user's sessions."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "events")


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its table (for results of the size of the windows)."""
    ensure_checkpoint_dir(stream.sparkSession)
    folder = f"{stream.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def load_incrementally(stream: DataFrame, store: Store, table: str, key: list[str], checkpoint: str) -> None:
    """Loads a stream of rows into a table, each batch as an upsert: a batch that is run again changes nothing.

    The index is walking while it loads, ready after, failed where a batch fails.
    """

    def load(batch: DataFrame, _: int) -> None:
        store.upsert(table, batch, key)

    store.set_state("walking")
    try:
        stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    except Exception:
        store.set_state("failed")
        raise
    store.set_state("ready")
