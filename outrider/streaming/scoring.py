"""Scoring of a stream by the batch functions, with an audit row for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(rows: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, audit: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each micro-batch's scored rows under ``out/batch=<id>`` and one audit row under ``audit/batch=<id>``.

    A batch that is tried again after a failure replaces what its first try left, so each counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.agg(F.count("*").alias("rows"), F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{audit}/batch={batch_id}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_rates(events: DataFrame, ts: str = "ts", label: str = "label", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and the label's rate of each window; later rows than the watermark allows are dropped."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.avg(label).alias("rate")).select(F.col("w.start").alias("window_start"), "n", "rate")
