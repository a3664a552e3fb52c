"""Streaming queries whose results equal those of a batch; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reprolens.sources.tables import table
from reprolens.streaming import incremental as inc


def _events(spark, sf):
    frame = inc.read(spark, sf, table(spark, sf, "events").schema, "events.parquet")
    return frame


def stream_incremental(spark, sf):
    counts = _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return inc.drain_complete(counts, spark)


def stream_dedup(spark, sf):
    seen = inc.unseen(_events(spark, sf).select("user_id", "event_type"), "user_id", "event_type")
    return spark.read.parquet(inc.drain(seen, spark))


def window_counts(spark, sf):
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = inc.drain_complete(inc.windowed(e, "ts", "1 day", "1 day", "event_type"), spark)
    return counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_rescore(spark, sf):
    """Users with new events, scored anew for each batch; a batch writes its own folder, so a repeated one replaces itself."""
    out = inc.place(spark, "scores")

    def score(batch, number):
        batch.groupBy("user_id").agg(F.max("event_id").alias("last"), F.count_if(F.col("event_type") == "error").alias("n_errors")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    inc.each_batch(_events(spark, sf), spark, score)
    return spark.read.parquet(out).groupBy("user_id").agg(F.max("last").alias("last"), F.sum("n_errors").alias("n_errors"))


QUERIES = {f.__name__: f for f in (stream_incremental, stream_dedup, window_counts, stream_rescore)}
ORACLES = {
    "stream_incremental": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_rescore": "SELECT user_id, max(event_id) AS last, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY 1",
}
