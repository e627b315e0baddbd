"""Vector codes by Lloyd's rounds over members that stay where they are.

Components become integers floor(4096 x), a vector is cut into PARTS equal consecutive parts, and
each part position has a codebook of up to ENTRIES entries. A member is one part of one vector. It
lives in the partition of its (position, entry, salt), salts being as many as partitions, so an
entry that holds a third of all members is spread over every one of them.

A round has two steps. Every partition assigns its resident members to the nearest entries (squared
Euclidean distance, ties to the lower index); members whose entry changed are written to the next
shuffle, all others are read again where they are. Then owners sum their members per entry, sums
meet per position (ENTRIES rows of sums each), and the driver divides, rounding down: codebooks are all
that it holds. Members travel as blocks of packed integers, joined to blocks of bounded size when
read, so a partition is never held whole. Lost partitions are recomputed from the stored vectors and
the moves since; all arithmetic is on integers, so they come back equal.

RDDs are used for the rounds because DataFrames forget their partitioning at a checkpoint, and a
union of resident and arriving rows would shuffle both.

Vectors that are null or hold null or non-finite components are dropped. Vectors of each length have
codebooks of their own (parts cut at floor(k * length / PARTS)); an empty vector has error 0.
Components of 16,384 and more in size count as 16,384, so that all sums fit 64 bits. Of rows with equal
vec_id the smaller vector comes first, a null vec_id before all. Repeated rows each count; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.registry import query
from treeledger.operators.durable import durable, fetch
from treeledger.operators.ordered import top_per_group
from treeledger.sources.adapters import table

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE, LARGEST = 4096, 2**26
BLOCK_VALUES = 1 << 16

#: (length, position) -> entries x width integers
Codebooks = dict[tuple[int, int], np.ndarray]


def bounds(length: int, position: int) -> slice:
    return slice(position * length // PARTS, (position + 1) * length // PARTS)


def integers(vectors: DataFrame) -> DataFrame:
    """Stored row_id, vec_id, label, length and whole components of the usable vectors."""
    x = F.col("embedding")
    usable = x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    return durable(vectors.where(usable).select(F.monotonically_increasing_id().alias("row_id"), "vec_id", "label", F.size(x).alias("length"), whole.alias("whole")))


def first_codebooks(rows: DataFrame, entries: int) -> Codebooks:
    """The parts of the smallest vec_ids of each length."""
    order = [F.col("vec_id").asc_nulls_first(), F.col("whole")]
    first = top_per_group(rows.select("length", "vec_id", "whole"), ["length"], order, entries, "rank_").collect()
    found: Codebooks = {}
    for length in {r.length for r in first}:
        vectors = np.array([r.whole for r in sorted((r for r in first if r.length == length), key=lambda r: r.rank_)], dtype=np.int64)
        found |= {(length, p): vectors[:, bounds(length, p)] for p in range(PARTS)}
    return found


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part, and its squared distance."""
    far = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    index = far.argmin(axis=1)
    return index, far[np.arange(len(parts)), index]


def home(slot: tuple[int, int], entry: np.ndarray, row_id: np.ndarray, partitions: int) -> np.ndarray:
    """The partition of (position, entry, salt); the salt is the row's remainder."""
    return (row_id + 37 * (slot[1] * ENTRIES + entry.astype(np.int64))) % partitions


def own(partition: int) -> int:
    return partition


def packed(slot: tuple[int, int], entry: np.ndarray, row_id: np.ndarray, parts: np.ndarray) -> tuple:
    return slot, entry.astype(np.int8).tobytes(), row_id.astype(np.int64).tobytes(), parts.astype(np.int32).tobytes()


def joined(records: Iterator[tuple]) -> Iterator[tuple]:
    """slot, entry, row_id, parts of bounded blocks, each joined from the small ones of its slot."""
    waiting: dict[tuple[int, int], list] = {}
    held: dict[tuple[int, int], int] = {}

    def give(slot):
        entry, row_id, parts = map(b"".join, zip(*waiting.pop(slot), strict=True))
        held.pop(slot)
        n = len(entry)
        return slot, np.frombuffer(entry, np.int8), np.frombuffer(row_id, np.int64), np.frombuffer(parts, np.int32).astype(np.int64).reshape(n, -1)

    for _, (slot, *block) in records:
        waiting.setdefault(slot, []).append(block)
        held[slot] = held.get(slot, 0) + max(len(block[2]) // 4, len(block[0]))
        if held[slot] >= BLOCK_VALUES:
            yield give(slot)
    for slot in list(waiting):
        yield give(slot)


def dealt(slot, entry, row_id, parts, partitions: int) -> Iterator[tuple]:
    """Members grouped by the partition they belong to."""
    to = home(slot, entry, row_id, partitions)
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(to[at[0]]), packed(slot, entry[at], row_id[at], parts[at])


def settle(rows: DataFrame, codebooks: Codebooks, partitions: int) -> RDD:
    """The first assignment: every part of every vector, in the partition of its entry."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_id, lengths = batch.column("row_id").to_numpy(), batch.column("length").to_numpy()
            values, out = batch.column("whole").flatten().to_numpy().astype(np.int64), []
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
            for length in map(int, np.unique(lengths)):
                picked = np.flatnonzero(lengths == length)
                vectors = values[(starts[picked, None] + np.arange(length)[None]).astype(np.int64)]
                step = max(1, BLOCK_VALUES // max(1, length))
                for k in range(0, len(picked), step):
                    for p in range(PARTS):
                        parts = vectors[k:k + step, bounds(length, p)]
                        entry, _ = nearest(parts, codebooks[length, p])
                        out += [(to, length, p, *block[1:]) for to, block in dealt((length, p), entry, row_id[picked[k:k + step]], parts, partitions)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                names=["to", "length", "position", "entry", "row_id", "parts"])

    blocks = rows.select("row_id", "length", "whole").mapInArrow(cut, "to int, length int, position int, entry binary, row_id binary, parts binary")
    return blocks.rdd.map(lambda r: (r[0], ((r[1], r[2]), bytes(r[3]), bytes(r[4]), bytes(r[5])))).partitionBy(partitions, own)


def judged(members: RDD, codebooks: Codebooks, partitions: int) -> RDD:
    """(changed, partition, block): resident members by their nearest entries, those that change apart."""
    def assign(records: Iterator[tuple]) -> Iterator[tuple]:
        for slot, entry, row_id, parts in joined(records):
            now, _ = nearest(parts, codebooks[slot])
            for changed in (False, True):
                at = np.flatnonzero((now != entry) == changed)
                for to, block in dealt(slot, now[at], row_id[at], parts[at], partitions):
                    yield changed, to, block

    return members.mapPartitions(assign, preservesPartitioning=True)


def summed(members: RDD, codebooks: Codebooks, partitions: int) -> Codebooks:
    """Codebooks whose entries are the means of their members, rounded down; unused entries stay."""
    def sums(records: Iterator[tuple]) -> Iterator[tuple]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for slot, entry, _, parts in joined(records):
            belongs = (entry[None] == np.arange(ENTRIES)[:, None]).astype(np.int64)
            both = np.concatenate([belongs.sum(axis=1, keepdims=True), belongs @ parts], axis=1)
            total[slot] = total[slot] + both if slot in total else both
        yield from total.items()

    found = dict(codebooks)
    for slot, both in members.mapPartitions(sums).reduceByKey(lambda a, b: a + b, min(partitions, len(codebooks) or 1)).collect():
        both, used = both[:len(codebooks[slot])], both[:len(codebooks[slot]), 0] > 0
        found[slot] = np.where(used[:, None], both[:, 1:] // np.maximum(both[:, :1], 1), codebooks[slot])
    return found


def trained(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[RDD, Codebooks]:
    """Resident members after the last round, and the codebooks that it left."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    codebooks = first_codebooks(rows, entries)
    members = settle(rows, codebooks, partitions).persist(StorageLevel.MEMORY_AND_DISK)
    kept = [members]
    for k in range(rounds):
        if k:
            seen = judged(members, codebooks, partitions).persist(StorageLevel.MEMORY_AND_DISK)
            stay = seen.filter(lambda r: not r[0]).mapPartitions(lambda records: ((to, block) for _, to, block in records), preservesPartitioning=True)
            move = seen.filter(lambda r: r[0]).map(lambda r: (r[1], r[2])).partitionBy(partitions, own)
            members = stay.union(move)
            kept.append(seen)
        codebooks = summed(members, codebooks, partitions)
        for old in kept[:-2]:
            old.unpersist()
        kept = kept[-2:]
    return members, codebooks


def encoded(members: RDD, codebooks: Codebooks, spark: SparkSession) -> DataFrame:
    """row_id, position, entry and squared distance of every member, by a last assignment."""
    def finish(records: Iterator[tuple]) -> Iterator[tuple]:
        for slot, _, row_id, parts in joined(records):
            entry, far = nearest(parts, codebooks[slot])
            yield slot[1], bytearray(row_id.tobytes()), bytearray(entry.astype(np.int64).tobytes()), bytearray(far.tobytes())

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for position, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row_id, entry, far = (np.frombuffer(b, np.int64) for b in block)
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (row_id, np.full(len(row_id), position), entry, far)], names=["row_id", "position", "entry", "error"])

    blocks = spark.createDataFrame(members.mapPartitions(finish), "position long, row_id binary, entry binary, error binary")
    return blocks.mapInArrow(opened, "row_id long, position long, entry long, error long")


def book_digests(codebooks: Codebooks) -> dict[int, str]:
    """Per vector length the digest of all entries' components, part by part."""
    lengths = {length for length, _ in codebooks}
    text = {n: ",".join(str(v) for p in range(PARTS) for v in codebooks[n, p].reshape(-1).tolist()) for n in lengths}
    return {n: hashlib.sha256(t.encode()).hexdigest() for n, t in text.items()}


def codes(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, label, length, code (two hex digits per part), error and codebooks_sha256 of every usable vector."""
    spark = vectors.sparkSession
    rows = integers(vectors)
    members, codebooks = trained(rows, rounds, entries)
    place = F.expr(f"shiftleft(entry, CAST(8 * ({PARTS - 1} - position) AS INT))")
    whole = encoded(members, codebooks, spark).groupBy("row_id").agg(F.sum(place).alias("all_"), F.sum("error").alias("error"))
    books = spark.createDataFrame(list(book_digests(codebooks).items()), "length int, codebooks_sha256 string")
    return (
        rows.drop("whole").join(whole, "row_id").join(F.broadcast(books), "length")
        .select("vec_id", "label", "length", F.lower(F.lpad(F.hex("all_"), 2 * PARTS, "0")).alias("code"), "error", "codebooks_sha256")
    )


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the error summed over equal labels, nulls together."""
    stored = durable(coded.withColumn("label_", F.coalesce(F.concat(F.lit("l"), F.col("label").cast("string")), F.lit("n"))))
    totals = durable(stored.groupBy("label_").agg(F.sum("error").alias("label_error")))
    return fetch(stored, totals, ["label_"]).drop("label_")


def round_sql(k: int) -> str:
    """Assignment of all parts to codebook k-1, and codebook k."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT rid, n, p, part, min(far * 16 + e) % 16 AS e, min(far * 16 + e) // 16 AS far FROM (
    SELECT rid, part.n, part.p, part, e,
      coalesce(list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - entry[i]) * (part[i] - entry[i]))), 0)::BIGINT AS far
    FROM part JOIN c{k - 1} c ON c.n = part.n AND c.p = part.p) GROUP BY rid, n, p, part
),
m{k} AS (
  SELECT n, p, e, list(mean ORDER BY i) AS entry FROM (
    SELECT n, p, e, i, CAST(floor(sum(part[i]) / count(*)) AS BIGINT) AS mean FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM a{k}) GROUP BY n, p, e, i)
  GROUP BY n, p, e
),
c{k} AS MATERIALIZED (SELECT c.n, c.p, c.e, coalesce(m.entry, c.entry) AS entry FROM c{k - 1} c LEFT JOIN m{k} m ON m.n = c.n AND m.p = c.p AND m.e = c.e)"""


CODES_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, len(embedding) AS n,
    list_transform(embedding, lambda x: CAST(floor(least(greatest({SCALE} * CAST(x AS DOUBLE), -{LARGEST}), {LARGEST})) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
part AS MATERIALIZED (SELECT rid, n, p, v[p * n // {PARTS} + 1 : (p + 1) * n // {PARTS}] AS part FROM kept, range({PARTS}) AS r(p)),
c0 AS MATERIALIZED (
  SELECT n, p, e, part AS entry FROM part JOIN (
    SELECT rid, row_number() OVER (PARTITION BY n ORDER BY vec_id NULLS FIRST, v) - 1 AS e FROM kept) USING (rid) WHERE e < {ENTRIES}
),{",".join(round_sql(k) for k in range(1, ROUNDS + 2))},
books AS (SELECT n, sha256(array_to_string(flatten(list(entry ORDER BY p, e)), ',')) AS codebooks_sha256 FROM c{ROUNDS} GROUP BY n),
coded AS (
  SELECT rid, n, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{ROUNDS + 1} GROUP BY rid, n
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid) JOIN books ON books.n = kept.n
"""


@query("op12_member_lloyd", CODES_SQL)
def op12_member_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_label_error(codes(table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
