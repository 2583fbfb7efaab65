"""Windowed aggregates over event streams: the same functions on ``readStream`` and on batch DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, late: str | None) -> DataFrame:
    df = events.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, late) if events.isStreaming and late else df


def windowed(
    events: DataFrame, time: str, width: str, aggregates: dict[str, Column], by: list[str] | None = None, slide: str | None = None, late: str | None = "1 hour"
) -> DataFrame:
    """Tumbling windows, or sliding ones with ``slide``; on a stream, rows later than ``late`` are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = _timed(events, time, late).groupBy(w, *(by or [])).agg(*(c.alias(a) for a, c in aggregates.items()))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(by or []), *aggregates)


def sessions(events: DataFrame, time: str, gap: str, aggregates: dict[str, Column], by: list[str], late: str | None = "1 hour") -> DataFrame:
    """Sessions per key: stretches without a pause of ``gap``."""
    out = _timed(events, time, late).groupBy(F.session_window(time, gap), *by).agg(*(c.alias(a) for a, c in aggregates.items()))
    return out.select(F.col("session_window.start").alias("window_start"), F.col("session_window.end").alias("window_end"), *by, *aggregates)


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all there is and end; a later call goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
