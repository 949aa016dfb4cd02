"""Occurrence pieces as a stream: filtering, deduplication in bounded state, resumable writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from glyphdrift.operators import quality


def occurrence_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 8) -> DataFrame:
    """Rows of the Parquet files that arrive in a folder, ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def cleaned_stream(stream: DataFrame, mode: str = "conservative") -> DataFrame:
    """Rows the first cleaning lets through; no state."""
    return stream.where(quality.removal_reason(F.col("sentence"), mode).isNull())


def timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """With a watermark on ``time``; times without zone are taken in the session's zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def unique_stream(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; state is kept for ``late`` behind the newest time."""
    return timed(stream, time, late).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, keys: list[str], time: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows per key and time window, final once the watermark has passed."""
    return timed(stream, time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def written(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything available to a folder; a restart goes on behind what was written."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
