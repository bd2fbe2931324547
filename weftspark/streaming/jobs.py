"""Incremental ingest and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.sources.writers import append_new


def windowed_counts(events: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), width: str = "5 minutes", slide: str | None = None, late: str | None = None, id_col: str | None = None) -> DataFrame:
    """Counts per window and keys. On a stream, `late` sets the watermark; with id_col, an event delivered again within it counts once."""
    e = events
    if late:
        e = e.withWatermark(ts, late)
        if id_col:
            e = e.dropDuplicatesWithinWatermark([id_col]) if e.isStreaming else e.dropDuplicates([id_col])
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return e.groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def over_limit(requests: DataFrame, ts: str, client: str, limit: int = 10, width: str = "1 minute") -> DataFrame:
    """(start, client, n): clients with more than `limit` requests in a window."""
    return windowed_counts(requests, ts, (client,), width).where(F.col("n") > limit).select("start", client, "n")


def ingest(spark: SparkSession, source: str, schema: str, target: str, key: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> int:
    """New files of a folder through a transformation into a table, each key once: available files as micro-batches, then stop. Returns the rows added."""
    added: list[int] = []

    def write(batch: DataFrame, _: int) -> None:
        added.append(append_new(batch.sparkSession, transform(batch), target, key))

    q = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(added)


def query_log(requests: DataFrame, columns: dict[str, Column], path: str, checkpoint: str):
    """An append-only log of a request stream."""
    return requests.select(*(c.alias(n) for n, c in columns.items())).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
