"""Incremental builds: what arrived since the last run, each record once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def incremental(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame]) -> None:
    """Runs ``step`` over the records that are new in ``folder`` and appends its
    rows to ``out``. The checkpoint remembers files; a batch that is run again
    replaces its own rows, since each batch writes a partition of its own."""

    def write(batch: DataFrame, number: int) -> None:
        rows = step(batch).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    stream = spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(write)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and type; batch and streaming alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
