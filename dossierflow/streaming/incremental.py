"""Incremental evaluation: the batch transforms applied to micro-batches.

Progress lives in the stream's checkpoint, so stopping and starting again
resumes behind the last finished batch (pause, resume, stop). Each batch is
written under its own number and written over if it runs again, which makes
the sink idempotent.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.session import ensure_checkpoint_dir


def stream_table(spark: SparkSession, data_dir: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """A table as a stream of its files, with the schema of what is there."""
    path = f"{data_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # as a pattern the path may be one file or a directory of files
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path[:-1] + "[t]")


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Processes what is there with `transform` and gives everything written so far."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    out, checkpoint = out or f"{base}/out", checkpoint or f"{base}/state"

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that no earlier run has processed."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def windowed_counts(events: DataFrame, ts: str, width: str, late: str = "1 day") -> DataFrame:
    """Events by type in tumbling windows, with a watermark for streams (an extension: batch tools have none)."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def run_windowed(stream: DataFrame, ts: str, width: str) -> DataFrame:
    """Windowed counts of a stream; the state is written out whole, so late rows correct earlier windows."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    counted = windowed_counts(stream, ts, width)
    query = counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(f"{base}/out")
    last = got.agg(F.max("batch")).head()[0]
    return got.where(F.col("batch") == last).drop("batch")
