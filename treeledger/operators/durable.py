"""Cutting lineage so that a lost executor costs a re-read, not a recompute."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, local mode (one machine, as in tests) gets a private folder and
    a cluster one inside its warehouse; a machine-local path on a cluster is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and sc.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="spark-")
    elif not root:
        root = spark.conf.get("spark.sql.warehouse.dir", "") + "/_checkpoints"
        if root.startswith(("file:", "/")):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the checkpoint folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again; ``before``, an earlier such table, is removed.

    For loops: a checkpoint carries the estimated size of its plan along, and a join multiplies the sizes of
    its sides, so the estimate of a table joined with itself in every round has a number of digits that grows
    by the power of the rounds. A table that is read has the size of its files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if before is not None and hasattr(before, "stored_at"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(before.stored_at)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    again = spark.read.schema(df.schema).parquet(path)
    again.stored_at = path
    return again


BROADCAST_ROWS = 100_000


def fetch(big: DataFrame, stored_keys: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``big`` for a stored set of keys, without shuffling ``big`` when the set is small.

    ``stored_keys`` is already materialised, so counting it is cheap. Up to ``limit``
    rows (a few tens of megabytes of paths) it is broadcast and the wide side stays
    where it was read; beyond that Spark joins by shuffle. The hint says so: a stored table keeps the
    estimate of its plan, which may be far too low, and Spark would broadcast it unchecked.
    """
    keys = broadcast(stored_keys) if stored_keys.count() <= limit else stored_keys.hint("merge")
    return big.join(keys, on, how)


# Fixed size of a sieve, 16 MB of bits however many keys there are, in bitmaps as long as Spark's own.
SIEVE_BITS = 2**27
BITMAP_BITS = 32_768
# Types whose equal values have equal strings.
SIEVED = {"string", "tinyint", "smallint", "int", "bigint"}


def sieved(big: DataFrame, stored_keys: DataFrame, on: list[str], bits: int = SIEVE_BITS) -> DataFrame:
    """Rows of ``big`` that may have one of the stored keys: all that have, and few others.

    A hash of each key sets one bit, and the bits are broadcast, not the keys, so ``big`` is not shuffled. A row without
    a key passes with a chance of at most keys / ``bits``, so an exact join must follow. The bits take the same memory for any
    number of keys; with too many of them more rows pass and nothing is lost.
    """
    if any(dict(frame.dtypes)[c] not in SIEVED for frame in (big, stored_keys) for c in on):
        return big
    place = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in on]), F.lit(bits))
    bucket, at = F.floor(place / BITMAP_BITS).cast("int"), place % BITMAP_BITS
    every = big.sparkSession.range(-(-bits // BITMAP_BITS)).select(F.col("id").cast("int").alias("_bucket"), F.lit(None).cast("bigint").alias("_at"))
    # Places are dealt before they become bitmaps: a task's own bitmaps would be many and nearly empty.
    places = stored_keys.select(bucket.alias("_bucket"), at.alias("_at")).unionByName(every).repartition("_bucket")
    maps = places.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_map"))
    row = maps.agg(F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_map"))), lambda m: m["_map"]).alias("_maps"))
    byte = F.substring(F.element_at("_maps", bucket + 1), F.floor(at / 8).cast("int") + 1, F.lit(1))
    return big.join(broadcast(row), F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1, "left_semi")


def fetch_measured(
    big: DataFrame, stored_keys: DataFrame, on: list[str], measures: list[Column], limit: int = BROADCAST_ROWS, by: list[str] | None = None,
) -> DataFrame:
    """As ``fetch``, for a wide column of which only ``measures`` are needed, dealt by the columns ``by`` (some of ``on``) if given.

    They are computed behind a broadcast for the wanted rows alone. Where the keys are too many for that, the rows
    pass a sieve of the keys first, and their measures go to the shuffle instead of the wide column. Rows dealt by ``by`` are
    shuffled once in both cases.
    """
    if stored_keys.count() <= limit:
        found = big.join(broadcast(stored_keys), on).select(*stored_keys.columns, *measures)
        return found.repartition(*by) if by else found
    narrow = sieved(big, stored_keys, on).select(*on, *measures)
    return _joined_by(narrow, stored_keys, on, by) if by else narrow.join(stored_keys.hint("merge"), on)


def _joined_by(left: DataFrame, right: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """The inner join on ``on``, dealt by fewer columns; a join would deal both sides by all of them."""
    sides = [F.struct(*[c for c in frame.columns if c not in on]).alias(name) for frame, name in ((left, "_left"), (right, "_right"))]
    both = left.select(*on, sides[0]).unionByName(right.select(*on, sides[1]), allowMissingColumns=True).dropna(subset=on)
    met = both.repartition(*by).groupBy(*on).agg(F.collect_list("_left").alias("_left"), F.collect_list("_right").alias("_right"))
    one = met.select(*on, "_left", F.explode("_right").alias("_right"))
    return one.select(*on, "_right", F.explode("_left").alias("_left")).select(*on, "_right.*", "_left.*")
