"""The activity journal as a stream: events once each, counts by window, and the newest state of each object.

Every function takes a batch or a streaming DataFrame; `run` drives a stream over all that is there, and again from where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(events: DataFrame, at: str, late: str) -> DataFrame:
    """With a watermark; times without a zone are taken in the session's."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def once(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 day") -> DataFrame:
    """Events without repeats of their id. A stream keeps the ids of the last `late` only, so its state is bounded."""
    if events.isStreaming:
        return _timed(events, at, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def windows(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, kind, n, total) for each window of time; a stream's windows close once they are `late` old."""
    given = _timed(events, at, late) if events.isStreaming else events
    out = given.groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), kind, "n", "total")


def newest(events: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """(key, events, columns...): of each object's events the last one's columns. One row of state for each object."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return events.groupBy(key).agg(F.count("*").alias("events"), last.alias("last")).select(key, "events", "last.*")


def run(spark: SparkSession, source: DataFrame, build: Callable[[DataFrame], DataFrame], out: str, progress: str, mode: str = "complete") -> DataFrame:
    """The result of build over the stream source, as a table at out; progress is the stream's checkpoint folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    made = build(source)
    made.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out)
