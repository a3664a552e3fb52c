"""Streams: process what is new once, drop keys seen before, count in event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprolens.sources.staging import shared_dir


def read(spark: SparkSession, folder: str, schema, name: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """A stream over the files of a folder whose names match."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(folder)


def place(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def drain(frame: DataFrame, spark: SparkSession, checkpoint: str | None = None, mode: str = "append") -> str:
    """Runs a stream over all that is there now, then stops; returns the folder of the written rows.

    With the same checkpoint, a later run goes on where this one stopped.
    """
    out = place(spark, "stream")
    query = frame.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint or place(spark, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def drain_complete(frame: DataFrame, spark: SparkSession, checkpoint: str | None = None) -> DataFrame:
    """Runs an aggregation over all that is there now; the result of the last batch replaces those before it."""
    out = place(spark, "stream")
    query = frame.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint or place(spark, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def each_batch(frame: DataFrame, spark: SparkSession, handle: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Calls ``handle`` with each new batch; a batch that fails comes again with the same number, so handlers write by number."""
    query = frame.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint or place(spark, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()


def unseen(frame: DataFrame, *key: str, time: str | None = None, late: str = "7 days") -> DataFrame:
    """Each key once, however often it comes. With a ``time`` column, a key is forgotten once it is ``late`` behind, which bounds the state."""
    if time is None:
        return frame.dropDuplicates(list(key))
    return frame.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def windowed(frame: DataFrame, time: str, length: str, late: str, *key: str) -> DataFrame:
    """Counts in tumbling windows of event time; rows later than ``late`` are dropped."""
    return frame.withWatermark(time, late).groupBy(F.window(time, length), *key).agg(F.count("*").alias("n"))
