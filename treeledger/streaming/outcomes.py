"""Arrivals as a stream: outcomes, audit log, and the tables that follow from them.

Each micro-batch is the batch operator ``history.ingest_outcomes`` run against what
earlier batches stored. A batch writes only under its own ``batch_id`` partition and
reads only smaller ones, so a replayed batch overwrites itself and nothing is
counted twice, whatever executor or driver was lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import history

SEEN = "archive_key string, first_seen timestamp, last_seen timestamp, times_seen bigint, source_name string, batch_id bigint"
VERSIONS = "artifact {artifact}, tree_key string, seq bigint, ts timestamp, batch_id bigint"


def file_arrivals(spark: SparkSession, folder: str, max_age: str | None = None, glob: str = "*.[zZ][iI][pP]") -> DataFrame:
    """Files appearing in a folder, oldest first, the backlog included."""
    reader = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).option("latestFirst", False)
    if max_age:
        reader = reader.option("maxFileAge", max_age)
    return reader.load(folder)


def table_arrivals(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Rows of parquet files appearing under a path pattern."""
    return spark.readStream.schema(schema).parquet(pattern)


def _stored(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col("batch_id") < before)


def _store(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def process_batch(arrivals: DataFrame, batch_id: int, root: str, order: tuple[str, str] = ("ts", "event_id")) -> None:
    """Outcomes of one micro-batch, its new versions, its seen contents and its log."""
    spark = arrivals.sparkSession
    kind = dict(arrivals.dtypes)["artifact"]
    seen = _stored(spark, f"{root}/seen", SEEN, batch_id)
    versions = _stored(spark, f"{root}/versions", VERSIONS.format(artifact=kind), batch_id)
    outcomes = history.ingest_outcomes(arrivals, seen, versions, order)
    _store(outcomes, f"{root}/outcomes", batch_id)
    # Later steps read what was just stored instead of computing it again.
    done = spark.read.schema(outcomes.schema).parquet(f"{root}/outcomes/batch_id={batch_id}")
    new = done.where(F.col("status") == "new").select("artifact", F.col("tree_key").cast("string").alias("tree_key"), "seq", F.col("ts").cast("timestamp").alias("ts"))
    _store(new, f"{root}/versions", batch_id)
    counters = history.seen_counters(done, "archive_key", "kind", order)
    _store(counters.select("archive_key", F.col("first_seen").cast("timestamp").alias("first_seen"), F.col("last_seen").cast("timestamp").alias("last_seen"), "times_seen", "source_name"),
           f"{root}/seen", batch_id)
    log = done.select("ts", F.col("status").alias("kind"), "artifact", "seq", F.col("kind").alias("source"), F.to_json(F.struct("archive_key", "tree_key")).alias("detail"))
    _store(log, f"{root}/log", batch_id)


def start_outcomes(arrivals: DataFrame, root: str, checkpoint: str, order: tuple[str, str] = ("ts", "event_id"), trigger: dict | None = None) -> StreamingQuery:
    """Run ``process_batch`` on every micro-batch of an arrivals stream."""
    writer = arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: process_batch(df, n, root, order))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_outcomes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/outcomes")


def read_seen(spark: SparkSession, root: str) -> DataFrame:
    """Seen counters over all batches: partial counters per batch are merged."""
    return spark.read.parquet(f"{root}/seen").groupBy("archive_key").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times_seen").alias("times_seen"),
        F.min_by("source_name", F.struct("batch_id", "first_seen")).alias("source_name"))


def read_kept_versions(spark: SparkSession, root: str, keep: int = 0) -> DataFrame:
    """Versions after retention: the newest ``keep`` per artifact (0 keeps all)."""
    return history.retention(spark.read.parquet(f"{root}/versions"), keep)
