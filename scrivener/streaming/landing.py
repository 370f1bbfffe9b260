"""Landed documents as a stream: the same column functions, results appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scrivener.functions.quality import text_quality
from scrivener.functions.text import clean_text


def prepared(units: DataFrame) -> DataFrame:
    """Cleaned text and quality of units, batch or stream."""
    return units.withColumn("cleaned", clean_text(F.col("text"))).withColumn("quality", text_quality(F.col("text")))


def landed_units(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Process the Parquet files that have landed since the last run and append their prepared units.

    A row delivered again within a day is written once.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    late = rows.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", "1 day")
    once = late.dropDuplicatesWithinWatermark(["unit_id"])
    return prepared(once).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Units received by hour and source type, closed a day after the hour."""
    rows = spark.readStream.schema(schema).parquet(source)
    late = rows.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", "1 day")
    counts = late.groupBy(F.window("received_at", "1 hour"), "source_type").agg(F.count("*").alias("units"))
    flat = counts.select(F.col("window.start").alias("hour"), "source_type", "units")
    return flat.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
