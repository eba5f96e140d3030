"""Streaming forms of the batch operators: sessions, deduplication and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.operators.knowledge import upsert


def stream_sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of a stream: key, start_at, end_at (of the last event plus the gap), n; each is given
    out once the watermark has passed its end."""
    w = F.session_window(ts, gap)
    counted = events.withWatermark(ts, lateness).groupBy(key, w).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("session_window.start").alias("start_at"), F.col("session_window.end").alias("end_at"), "n")


def stream_once(rows: DataFrame, key: list[str], ts: str, lateness: str = "1 hour") -> DataFrame:
    """Each key once, of copies that arrive within the lateness."""
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(key)


def upsert_batches(path: str, key: list[str]):
    """A function for foreachBatch that keeps a table of the latest row of each key.

    A new version is written beside the old and named by its batch, so that a batch that is run again
    gives the same table and a lost executor leaves the last version whole.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates(key)
        target = f"{path}/version={batch_id:09d}"
        try:
            old = spark.read.parquet(f"{path}/version={batch_id - 1:09d}")
        except Exception:  # noqa: BLE001 - the first batch has none
            old = once.limit(0)
        upsert(old, once, key).write.mode("overwrite").parquet(target)

    return write
