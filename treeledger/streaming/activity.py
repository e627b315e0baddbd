"""Event-time operators on arrival streams: bursts, settling, silence, activity.

All of them need a watermark; rows later than it are dropped, and in append mode a
window is emitted once the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(rows: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Watermarked rows; zone-less times are read as UTC session times."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def first_of_burst(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key while the watermark still remembers it."""
    return rows.dropDuplicatesWithinWatermark(keys)


def recent_only(rows: DataFrame, ts: str, file_time: str, max_age_seconds: float) -> DataFrame:
    """Modify events of files not written within the window are dropped; 0 keeps all."""
    if max_age_seconds <= 0:
        return rows
    age = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(file_time).cast("timestamp"))) / 1e6
    return rows.where(age <= max_age_seconds)


def settled(rows: DataFrame, keys: list[str], signature: list[str], stable_seconds: float, gap: str, ts: str = "ts") -> DataFrame:
    """Signatures seen over at least ``stable_seconds`` without a pause of ``gap``."""
    held = rows.groupBy(*keys, *signature, F.session_window(ts, gap)).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    span = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6
    return held.where(span >= stable_seconds).select(*keys, *signature, "first_ts", "last_ts")


def silences(beats: DataFrame, source: str, stale: str, ts: str = "ts") -> DataFrame:
    """A source that went quiet for ``stale``: when it last beat, unless it stopped cleanly."""
    live = beats.groupBy(source, F.session_window(ts, stale)).agg(
        F.max(ts).alias("last_beat"), F.max_by("stopped", ts).alias("stopped"))
    return live.where(~F.col("stopped")).select(source, "last_beat")


def activity(rows: DataFrame, keys: list[str], length: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return rows.groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        *keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def sessions(rows: DataFrame, keys: list[str], gap: str, ts: str = "ts") -> DataFrame:
    return rows.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n")).select(*keys, "first_ts", "last_ts", "n")
