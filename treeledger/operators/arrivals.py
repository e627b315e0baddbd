"""Arrivals: which count, what became of each, bursts, settling, liveness, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..options import ArrivalOptions
from .ordered import ordered

# Endings that look like archives but are not collected by default.
ARCHIVE_LIKE = (".jar", ".war", ".tar", ".tgz", ".gz", ".7z", ".rar")


def candidate_verdict(name: Column, options: ArrivalOptions = ArrivalOptions()) -> Column:
    """Why a file name is or is not collected; 'candidate' when it is."""
    suffix = paths.extension(name)
    return (
        F.when(name.startswith(".") | name.startswith("~$"), "hidden")
        .when(suffix.isin(*[s.lower() for s in options.partial_suffixes]), "partial")
        .when(suffix.isin(*[e.lower() for e in options.extensions]), "candidate")
        .when(suffix.isin(*ARCHIVE_LIKE), "archive of another kind")
        .otherwise("other")
    )


def recent(rows: DataFrame, ts: str, as_of: str, max_age_seconds: float) -> DataFrame:
    """Rows no older than ``max_age_seconds`` at ``as_of``; 0 turns the check off."""
    if max_age_seconds <= 0:
        return rows
    moment = F.lit(as_of).cast(dict(rows.dtypes)[ts])
    cutoff = moment - F.make_dt_interval(secs=F.lit(max_age_seconds).cast("decimal(18,6)"))
    return rows.where(F.col(ts) >= cutoff)


def burst_dedup(rows: DataFrame, keys: list[str], ts: str = "ts", tie: str = "event_id", gap_seconds: float = 300.0) -> DataFrame:
    """Drop a row that follows another of its key within the gap."""
    order = [F.col(ts), F.col(tie)]
    near = ordered(rows, keys, order, previous={"_before": ts})
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))) / 1e6
    return near.where(F.col("_before").isNull() | (gap >= gap_seconds)).drop("_before")


def runs(rows: DataFrame, keys: list[str], tag: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Runs of consecutive equal tags per key: number, length, first and last time."""
    order = [F.col(ts), F.col(tie)]
    marked = ordered(rows.withColumn("_tag", F.struct(*tag)), keys, order, previous={"_was": "_tag"})
    starts = marked.withColumn("_start", (F.col("_was").isNull() | (F.col("_was") != F.col("_tag"))).cast("bigint")).drop("_was")
    numbered = ordered(starts, keys, order, running={"run": "_start"})
    return numbered.groupBy(*keys, *tag, "run").agg(
        F.count(F.lit(1)).alias("length"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def stable_signatures(observations: DataFrame, keys: list[str], signature: list[str], options: ArrivalOptions = ArrivalOptions(), ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """First run per key that kept one signature long enough, unless given up before.

    One row per key: accepted_at (null when given up) and the signature accepted.
    """
    found = runs(observations, keys, signature, ts, tie)
    begun = found.groupBy(*keys).agg(F.min("first_ts").alias("begun"))
    settled = found.where(_seconds(F.col("last_ts"), F.col("first_ts")) >= options.stable_seconds)
    first = settled.groupBy(*keys).agg(F.min(F.struct("run", "first_ts", *signature)).alias("_f"))
    joined = begun.join(first, keys, "left")
    waited = _seconds(F.col("_f")["first_ts"], F.col("begun")) + options.stable_seconds
    accepted = waited <= options.give_up_seconds
    return joined.select(
        *keys, "begun", F.when(accepted, F.col("_f")["first_ts"]).alias("settled_from"),
        *[F.when(accepted, F.col("_f")[s]).alias(s) for s in signature])


def liveness_gaps(beats: DataFrame, keys: list[str], stale_seconds: float, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Beats followed by silence longer than ``stale_seconds``."""
    near = ordered(beats, keys, [F.col(ts), F.col(tie)], following={"next_ts": ts})
    gap = _seconds(F.col("next_ts"), F.col(ts))
    return near.where(gap > stale_seconds).select(*keys, F.col(ts).alias("last_beat"), "next_ts", F.floor(gap).cast("bigint").alias("silent_seconds"))


def activity(rows: DataFrame, keys: list[str], length: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Counts per tumbling (or sliding) window; counted before the shuffle."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return rows.groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        *keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def sessions(rows: DataFrame, keys: list[str], gap_seconds: float, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Sessions closed by a silence of ``gap_seconds``, by gaps in order (sliced when large)."""
    order = [F.col(ts), F.col(tie)]
    near = ordered(rows, keys, order, previous={"_before": ts})
    opens = F.col("_before").isNull() | (_seconds(F.col(ts), F.col("_before")) >= gap_seconds)
    numbered = ordered(near.withColumn("_open", opens.cast("bigint")).drop("_before"), keys, order, running={"session": "_open"})
    return numbered.groupBy(*keys, "session").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))
