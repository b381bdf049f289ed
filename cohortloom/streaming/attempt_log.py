"""Structured Streaming forms of the incremental operators: resumption, first copies and progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_deliveries(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """One copy of each message of a stream within the watermark; a copy later than that is late data and dropped.

    A message with a null key is nobody's copy, as in the batch form. Batch deduplication over all stored messages remains
    the exact form (see operators.delivery).
    """
    from cohortloom.operators.delivery import folded

    parts = [folded(k) for k in keys]
    unknown = parts[0].isNull()
    for part in parts[1:]:
        unknown = unknown | part.isNull()
    # a key of its own instead of a second branch, whose watermark would stand still while it gets no rows
    own = F.when(unknown, F.expr("uuid()"))
    named = stream.withColumn("_key", F.struct(own.alias("own"), *(part.alias(f"k{i}") for i, part in enumerate(parts))))
    return named.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(events: DataFrame, time: str, by: Sequence[str], width: str = "1 hour", delay: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and value sums per tumbling or sliding window; complete once the watermark has passed."""
    frame = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, delay).groupBy(frame.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def append_pending(spark: SparkSession, stream: DataFrame, log_path: str, key: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Append rows whose key the log lacks, batch by batch; success and failure both count as done.

    Each batch meets the log as it is, so a batch that runs again after a loss adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.groupBy(*key).agg(F.first(F.struct(*(c for c in batch.columns if c not in key))).alias("r")).select(*key, "r.*")
        try:
            known = spark.read.schema(batch.schema).parquet(log_path).select(*key)
            fresh = fresh.join(known, list(key), "left_anti")
        except Exception as e:  # the first batch has no log yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.select(batch.columns).write.mode("append").parquet(log_path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
