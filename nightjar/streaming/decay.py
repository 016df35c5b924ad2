"""Extension: listening and event counts as streams (the batch engine has no streams)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from nightjar.operators import taste
from nightjar.operators.log import BatchLog


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per key and tumbling window; rows later than ``late`` are dropped by the watermark."""
    return (
        events.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, size).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("from_ts"), key, "n", "total")
    )


def keep_listening(plays: DataFrame, log: BatchLog, checkpoint: str, now: Column, every: int = 16, **trigger) -> StreamingQuery:
    """Start a stream of plays that adds each batch's sums to ``log`` (of ``taste.sums_log``) once, and compacts after each ``every`` batches.

    The log knows a batch by its number, so a batch that is sent again after a failure counts once.
    """

    def add(batch: DataFrame, number: int) -> None:
        if log.add(taste.listening_sums(taste.valid_plays(batch), now), f"stream-{number}") and number % every == every - 1:
            log.compact(lambda rows: taste.ripen_sums(rows, now))

    return plays.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
