"""Structured Streaming over the same expressions: files that arrive, and counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.sources import files


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of files as they arrive in ``folder``."""
    return files.ingest(spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "content"))


def classified(reports: DataFrame) -> DataFrame:
    """A stream (or table) of reports with its event class; no state."""
    return reports.withColumn("class", T.detect(F.col("text"))["class"])


def counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows by window of event time and type; on a stream, state older than ``late`` goes."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: rows with less than ``gap`` between them."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp("w.start").alias("start"), "n")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """All that is there now, appended to a Parquet table; the checkpoint makes reruns exact."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
