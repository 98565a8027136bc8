"""Structured Streaming: tiles filled as files arrive, and feature totals kept current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointloom.functions import grid


def stream_points(spark: SparkSession, folder: str, schema: str, files: int = 8) -> DataFrame:
    """New Parquet files of a folder as a stream, ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def latest_once(stream: DataFrame, key: str, event_time: str, late: str = "1 day") -> DataFrame:
    """Each record once, as long as its copies come within ``late`` of each other."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def append_tiles(stream: DataFrame, path: str, checkpoint: str, size: float, coarse: int = 16) -> StreamingQuery:
    """Append arriving points to tiled storage, partitioned as ``sources.tiled`` reads it."""
    t = stream.withColumns(grid.tile("x", "y", size))
    t = t.withColumns({"block_row": F.floor(F.col("tile_row") / coarse), "block_col": F.floor(F.col("tile_col") / coarse)})
    return t.writeStream.format("parquet").partitionBy("block_row", "block_col").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def windowed_totals(stream: DataFrame, event_time: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by feature and time window, complete once the watermark has passed the window."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, width), "feature").agg(F.sum("ct").alias("ct"))


def each_batch(stream: DataFrame, checkpoint: str, update) -> StreamingQuery:
    """Call ``update(batch, number)`` on every batch, such as a step of a topic model."""
    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
