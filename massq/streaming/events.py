"""Structured Streaming over arriving scans: chromatogram-like time bins with a watermark.

Each function takes a streaming (or batch) frame with an event time and returns the
aggregate; ``run_available`` processes what is there with exactly the plan of a
continuous run, from a file source to a Parquet sink with a checkpoint, so a rerun goes
on where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massq.operators.shared import shared_path


def binned(events: DataFrame, width: str, slide: str | None = None, key: str = "event_type", late: str = "1 day") -> DataFrame:
    """Count, sum and maximum of ``value`` by key in tumbling or sliding bins."""
    bins: Column = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(bins.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total", "top")


def sessions(events: DataFrame, gap: str, key: str = "user_id", late: str = "1 day") -> DataFrame:
    """Runs of events of a key without a longer gap."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n", "total")


def source(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """New Parquet files of a folder as a stream, with the schema of those that are there."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 16).parquet(path)


def sink(out: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch to the folder that has its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table/batch={number}")

    return write


def run_available(stream: DataFrame, out: str | None = None, mode: str = "complete") -> DataFrame:
    """Process all that has arrived and return the sink's table.

    ``complete`` keeps all bins: each batch is a table of its own, and the last one counts.
    ``append`` writes a bin once the watermark has passed it, into its batch's partition. So a batch
    that is played again after a failure takes its own place and changes nothing.
    """
    spark = stream.sparkSession
    out = out or shared_path(spark)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(sink(out)).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{out}/table")
    if mode == "complete":
        rows = rows.where(F.col("batch") == (rows.agg(F.max("batch")).first()[0] or 0))
    return rows.drop("batch")
