"""Trip counts over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, origin: str, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Trips of each origin in each window; events later than `late` are left out. The same for streams and tables."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window), origin).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), origin, "n")


def read_events(spark, path: str, schema, max_files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def start(stream: DataFrame, path: str, checkpoint: str):
    """Append to Parquet under path until what is there now has been read."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
