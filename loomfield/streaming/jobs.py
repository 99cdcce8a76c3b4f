"""Structured Streaming jobs: lines from a folder, detection, error counts by window, one query for each sink.

The checkpoint keeps what a write-ahead log and its cursor would; a sink of its own checkpoint fails and resumes alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect_format import detect_format


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """raw_log of every non-blank line of the text files that arrive in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return lines.select(F.col("value").alias("raw_log")).where(F.length(F.trim("raw_log")) > 0)


def with_format(lines: DataFrame) -> DataFrame:
    return lines.withColumn("log_format", detect_format(F.col("raw_log")))


def count_windows(events: DataFrame, time: str, by: list[str], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """by, start, n: events of each window. State goes once the watermark, `late` behind the latest time, has passed a window; later events are left out."""
    spans = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return spans.select(*by, F.col("w.start").alias("start"), "n")


def write_stream(events: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append to Parquet all that there is now, in several batches, then end. Each batch counts once, also after a restart."""
    writer = events.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start()
