"""Streams with state per key give what their batch twins give."""

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from treeledger.operators import arrivals, history
from treeledger.options import ArrivalOptions
from treeledger.sources import adapters
from treeledger.streaming import keyed

T = dt.datetime(2026, 1, 1)
BEAT = "event_id long, path string, ts timestamp, size int, stopped boolean"


def at(seconds):
    return T + dt.timedelta(seconds=seconds)


def parts(spark, data, schema, folder, n=3):
    """Files of ``n`` consecutive parts, read one a micro-batch."""
    size = -(-len(data) // n)
    for k in range(n):
        spark.createDataFrame(data[k * size:(k + 1) * size], schema).coalesce(1).write.parquet(f"{folder}/part{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def run(spark, df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name), query


@pytest.fixture(scope="module")
def supplied(spark, small_dir):
    df = adapters.arrivals(spark, str(small_dir)).withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts", "event_id")
    return df, df.collect()


def test_outcomes_and_counters_equal_batch(spark, supplied, tmp_path):
    batch, data = supplied
    live = parts(spark, data, batch.schema, str(tmp_path / "in"), 4)
    got, query = run(spark, keyed.outcomes(live), "keyed_outcomes", tmp_path)
    assert rows(got, "event_id", "status", "seq") == rows(history.ingest_outcomes(batch), "event_id", "status", "seq")
    want = history.seen_counters(batch)
    assert rows(keyed.counters(spark, str(tmp_path / "cp-keyed_outcomes")), *want.columns) == rows(want)
    later = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(later) <= 2 * len(data)


def test_burst_rule_is_the_batch_rule(spark, supplied, tmp_path):
    batch, data = supplied
    live = parts(spark, data, batch.schema, str(tmp_path / "in"), 3).withWatermark("ts", "1 day")
    got, _ = run(spark, keyed.burst_dedup(live, ["artifact"], gap_seconds=3 * 86400.0), "keyed_burst", tmp_path)
    seen = batch.agg(F.max("ts")).first()[0] - dt.timedelta(days=1, seconds=1)
    want = arrivals.burst_dedup(batch, ["artifact"], gap_seconds=3 * 86400.0).where(F.col("ts") < F.lit(seen))
    assert rows(got.where(F.col("ts") < F.lit(seen)), "event_id") == rows(want, "event_id") and 0 < want.count() < batch.count()


def test_unordered_rows_are_put_in_order(spark, tmp_path):
    data = [(k, "a", at(s), 0, False) for k, s in enumerate((100, 40, 0, 400, 130, 390, 1000))] + [(99, "end", at(5000), 0, False)]
    live = parts(spark, data, BEAT, str(tmp_path / "in"), 1).withWatermark("ts", "600 seconds")
    got, _ = run(spark, keyed.burst_dedup(live, ["path"], gap_seconds=100.0), "keyed_unordered", tmp_path)
    want = arrivals.burst_dedup(spark.createDataFrame(data[:-1], BEAT), ["path"], gap_seconds=100.0)
    assert rows(got, "path", "event_id") == rows(want, "path", "event_id") == [("a", 2), ("a", 5), ("a", 6)]


def test_files_settle_or_are_given_up(spark, tmp_path):
    data = [(i, "grow", at(i), min(i, 3), False) for i in range(8)] + [(100 + i, "never", at(30 * i), i, False) for i in range(12)] + [(300, "once", at(4), 1, False)]
    data = sorted(data, key=lambda r: r[2]) + [(999, "end", at(10_000), 0, False)]
    options = ArrivalOptions(stable_seconds=2.0, give_up_seconds=120.0)
    live = parts(spark, data, BEAT, str(tmp_path / "in")).withWatermark("ts", "10 seconds")
    got, _ = run(spark, keyed.stable_signatures(live, ["path"], ["size"], options), "keyed_settled", tmp_path)
    want = arrivals.stable_signatures(spark.createDataFrame(data[:-1], BEAT), ["path"], ["size"], options)
    assert rows(got, "path", "begun", "settled_from", "size") == rows(want, "path", "begun", "settled_from", "size")
    assert {r.path: r.size for r in got.collect()} == {"grow": 3, "never": None, "once": None}


def test_total_silence_is_reported(spark, tmp_path):
    beats = [(k, "a", at(60 * k), 0, False) for k in range(5)] + [(10, "a", at(2000), 0, False), (11, "b", at(2010), 0, False), (12, "c", at(2020), 0, True)]
    ticks = spark.createDataFrame([(at(s),) for s in (0, 3000, 9000)], "ts timestamp")
    ticks.coalesce(1).write.parquet(str(tmp_path / "ticks"))
    clock = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "ticks"))
    live = keyed.ticking(parts(spark, beats, BEAT, str(tmp_path / "in"), 1), clock, ["path"])
    got, _ = run(spark, keyed.silences(live, ["path"], 300.0), "keyed_quiet", tmp_path)
    gaps = arrivals.liveness_gaps(spark.createDataFrame(beats, BEAT), ["path"], 300.0)
    assert rows(gaps, "path", "last_beat") == [("a", at(240))]
    assert sorted((r.path, r.last_beat) for r in got.collect()) == [("a", at(240)), ("a", at(2000)), ("b", at(2010))]
