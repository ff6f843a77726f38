"""Incremental forms of the batch operators (an extension: they have no counterpart to match)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sampling import bottom_k


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, key, n, value by tumbling windows; rows later than the watermark are left out. For streams and tables alike."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n of sessions that a gap ends."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def merge_bottom_k(kept: DataFrame | None, batch: DataFrame, group: str, id_column: str, k: int, seed: int) -> DataFrame:
    """The bottom-k sample of what was kept and a new batch: the same as of all rows at once, so that a stream can keep k rows."""
    batch = batch.select(batch.columns)
    rows = batch if kept is None else kept.drop("rank").unionByName(batch)
    return bottom_k(rows, group, id_column, k, seed)
