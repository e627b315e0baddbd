"""Streams give what their batch twins give."""

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from treeledger.operators import arrivals, history
from treeledger.sources import adapters
from treeledger.streaming import activity, outcomes

ARRIVAL = "event_id long, ts timestamp, artifact long, kind string, archive_key string, tree_key string, value double"


@pytest.fixture(scope="module")
def arrival_folder(spark, small_dir, tmp_path_factory):
    """The supplied arrivals in four files of increasing time."""
    folder = str(tmp_path_factory.mktemp("arrivals"))
    rows_ = adapters.arrivals(spark, str(small_dir)).withColumn("ts", F.col("ts").cast("timestamp"))
    last = rows_.agg(F.max("event_id")).first()[0]
    for part in range(4):
        lo, hi = part * (last + 1) // 4, (part + 1) * (last + 1) // 4
        rows_.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.parquet(f"{folder}/part{part}")
    return folder, rows_


def stream(spark, folder):
    return spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_outcomes_equal_batch(spark, arrival_folder, tmp_path):
    folder, batch = arrival_folder
    root = str(tmp_path / "store")
    outcomes.start_outcomes(stream(spark, folder), root, str(tmp_path / "cp")).awaitTermination()
    got = outcomes.read_outcomes(spark, root)
    want = history.ingest_outcomes(batch)
    assert got.select("batch_id").distinct().count() == 4
    assert rows(got, "event_id", "status", "seq") == rows(want, "event_id", "status", "seq")
    assert rows(outcomes.read_seen(spark, root), "archive_key", "times_seen", "source_name") == rows(history.seen_counters(batch), "archive_key", "times_seen", "source_name")
    kept = outcomes.read_kept_versions(spark, root, 2)
    assert kept.groupBy("artifact").count().agg(F.max("count")).first()[0] == 2
    assert spark.read.parquet(f"{root}/log").count() == batch.count()


def test_replayed_batch_changes_nothing(spark, arrival_folder, tmp_path):
    folder, batch = arrival_folder
    root = str(tmp_path / "store")
    first = batch.where(F.col("event_id") < 300)
    second = batch.where((F.col("event_id") >= 300) & (F.col("event_id") < 500))
    for n, part in ((0, first), (1, second), (1, second), (0, first)):
        outcomes.process_batch(part, n, root)
    want = history.ingest_outcomes(batch.where(F.col("event_id") < 500))
    assert rows(outcomes.read_outcomes(spark, root), "event_id", "status", "seq") == rows(want, "event_id", "status", "seq")


def test_readding_old_content_is_unchanged(spark):
    t = dt.datetime(2026, 1, 1)
    data = [(i, t + dt.timedelta(minutes=i), "fn", k, a, tr) for i, (k, a, tr) in enumerate([("x", "z1", "A"), ("x", "z1", "A"), ("x", "z2", "A"), ("x", "z3", "B"), ("x", "z4", "A")])]
    df = spark.createDataFrame(data, "event_id long, ts timestamp, artifact string, kind string, archive_key string, tree_key string")
    assert rows(history.ingest_outcomes(df), "event_id", "status", "seq") == [
        (0, "new", 1), (1, "duplicate-download", None), (2, "unchanged", 1), (3, "new", 2), (4, "unchanged", 1)]


def run(spark, df, name, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_closed_windows_equal_batch(spark, arrival_folder, tmp_path):
    folder, batch = arrival_folder
    timed = activity.with_event_time(stream(spark, folder), delay="1 hour")
    got = run(spark, activity.activity(timed, ["kind"], "1 day"), "tumbling", tmp_path)
    want = set(rows(arrivals.activity(batch, ["kind"], "1 day"), "kind", "window_start", "n"))
    mine = set(rows(got, "kind", "window_start", "n"))
    assert mine <= want and len(mine) > 0.8 * len(want)


def test_closed_sessions_equal_batch(spark, arrival_folder, tmp_path):
    folder, batch = arrival_folder
    timed = activity.with_event_time(stream(spark, folder), delay="1 hour")
    got = set(rows(run(spark, activity.sessions(timed, ["artifact"], "6 hours"), "sessions", tmp_path), "artifact", "first_ts", "last_ts", "n"))
    want = set(rows(arrivals.sessions(batch, ["artifact"], 21600.0), "artifact", "first_ts", "last_ts", "n"))
    assert got <= want and len(got) > 0.8 * len(want)


def test_burst_settle_and_silence(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    at = lambda s: t + dt.timedelta(seconds=s)
    seen = [("a.zip", at(0), 10, False), ("a.zip", at(1), 20, False), ("a.zip", at(5), 20, False), ("b.zip", at(6), 5, True), ("end", at(100_000), 0, False)]
    folder = str(tmp_path / "obs")
    schema = "path string, ts timestamp, size long, stopped boolean"
    spark.createDataFrame(seen, schema).coalesce(1).write.parquet(folder)
    live = lambda: activity.with_event_time(spark.readStream.schema(schema).parquet(folder), delay="1 second")
    assert rows(run(spark, activity.first_of_burst(live(), ["path"]), "burst", tmp_path), "path") == [("a.zip",), ("b.zip",), ("end",)]
    stable = run(spark, activity.settled(live(), ["path"], ["size"], 2.0, "900 seconds"), "settled", tmp_path)
    assert rows(stable, "path", "size") == [("a.zip", 20)]
    quiet = run(spark, activity.silences(live(), "path", "300 seconds"), "quiet", tmp_path)
    assert rows(quiet, "path", "last_beat") == [("a.zip", at(5))]
    late = activity.recent_only(spark.createDataFrame([(at(400), at(0)), (at(10), at(0))], "ts timestamp, mtime timestamp"), "ts", "mtime", 300.0)
    assert late.count() == 1


def test_growing_file_settles_or_is_given_up(spark):
    t = dt.datetime(2026, 1, 1)
    grow = [(i, "grow", t + dt.timedelta(seconds=i), min(i, 3)) for i in range(8)] + [(100 + i, "never", t + dt.timedelta(seconds=300 * i), i) for i in range(8)]
    df = spark.createDataFrame(grow, "event_id long, path string, ts timestamp, size int")
    got = {r["path"]: (r["settled_from"], r["size"]) for r in arrivals.stable_signatures(df, ["path"], ["size"]).collect()}
    assert got == {"grow": (t + dt.timedelta(seconds=3), 3), "never": (None, None)}


def test_folder_backlog_is_read_oldest_first(spark, tmp_path):
    import os

    folder = tmp_path / "in"
    folder.mkdir()
    for i, name in enumerate(("new.zip", "old.zip", "note.txt")):
        (folder / name).write_bytes(b"x")
        os.utime(folder / name, (1_700_000_000 - 100 * i,) * 2)
    got = run(spark, outcomes.file_arrivals(spark, str(folder)).select("path", "modificationTime"), "files", tmp_path)
    assert [r["path"].rsplit("/", 1)[1] for r in got.orderBy("modificationTime").collect()] == ["old.zip", "new.zip"]
