"""Keeping a keyed table up to date from a stream of new rows or files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_by_key(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert_stream(stream: DataFrame, folder: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's last row per key, under its batch number; a batch that runs again replaces its own files."""

    def put(batch: DataFrame, batch_id: int) -> None:
        latest_by_key(batch, keys, order).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(table: DataFrame, keys: list[str]) -> DataFrame:
    """The table that the batches add up to: of each key the row of the latest batch."""
    return latest_by_key(table, keys, "batch").drop("batch")


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key and time window, with a watermark for late rows; works on streams and tables alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
