"""Passages and facts that keep arriving: deduplicated, counted in windows, written as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def first_arrivals(rows: DataFrame, key: str, at: str, late: str = "14 days") -> DataFrame:
    """Each key once, as first delivered; state older than the watermark is dropped, and with it what comes later still.

    Rows without a time cannot age: their keys are remembered for good, apart from those with a time.
    """
    timed = rows.where(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp"))
    untimed = rows.where(F.col(at).isNull()).withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, late).dropDuplicatesWithinWatermark([key]).unionByName(untimed.dropDuplicates([key]))


def counts_by_window(rows: DataFrame, at: str, by: str, width: str = "1 day", late: str = "14 days") -> DataFrame:
    """(start, by, n): rows a window and value, final once the watermark has passed the window's end."""
    timed = rows.where(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp"))
    grouped = timed.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), F.col(by)).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), by, "n")


def write_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes in what is there now, each batch once, and stops; called again it goes on from there."""
    return rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode("append").format("parquet").start(path)
