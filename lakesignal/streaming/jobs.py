"""Structured Streaming jobs: hourly windows, feedback weights, index appends; those with state of their own are in stateful."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, with the schema that its files have."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def hourly_totals(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by hour; events that come later than `late` behind the newest are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    hours = rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return hours.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def feedback_weights(ratings: DataFrame, up: float = 0.12, down: float = 0.15) -> DataFrame:
    """Running (key, weight); run in update mode, one keyed sum."""
    rows = ratings.select(F.explode("keys").alias("key"), F.when(F.col("positive"), up).otherwise(-down).alias("d"))
    return rows.groupBy("key").agg(F.round(F.sum("d"), 3).alias("weight"))


EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", empty_batches: bool = True) -> None:
    """All that is there, batch by batch, into an idempotent sink; starts again where the checkpoint ends.

    State that ends by the clock (processing time) always has another empty batch
    to run: such streams need empty_batches False, or they never come to an end.
    """
    conf = stream.sparkSession.conf
    before = conf.get(EMPTY_BATCHES)
    conf.set(EMPTY_BATCHES, str(empty_batches).lower())
    try:  # a query keeps the settings it starts with
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    finally:
        conf.set(EMPTY_BATCHES, before)
    query.awaitTermination()


def append_index(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that adds chunks to an index folder; a batch that is tried again replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def task_states(updates: DataFrame) -> DataFrame:
    """(task_id, status, progress): done and failed stay, else the furthest status and the greatest progress."""
    order = ("queued", "running", "indexing", "failed", "done")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    return updates.groupBy("task_id").agg(F.max_by("status", place).alias("status"), F.max("progress").alias("progress"))
