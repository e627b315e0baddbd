"""Documents packed into training sequences of several permitted lengths: variable-capacity best fit.

Items go in descending length into the open sequence with the least room that still fits.
Where none fits, the length is opened whose cost for each token it will hold is least: the
tokens it will hold are the item and, if enough smaller items are left, its whole room. At
the end each sequence shrinks to the shortest permitted length that holds its contents.

A sequence of length c costs ``start + c + c * c / quadratic``. Documents longer than the
longest sequence are cut into pieces of that length. Tokens are words here; give ``length``
for others. Items are dealt by a digest into groups of about ``group_items`` and each group is
packed alone: a group wastes at most its last few sequences, and no task holds more.

Null, empty and wordless texts are one row without a sequence; rows that repeat are items of
their own; a null doc_id is an id like any; an empty table gives no rows; extra columns are
dropped.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.registry import query
from treeledger.sources.adapters import table

PACKED = "doc_id long, piece int, first_token long, n_tokens long, sequence_id long, sequence_length int, position int"


@dataclass(frozen=True)
class Packing:
    lengths: tuple[int, ...] = (256, 512, 1024, 2048, 4096)
    start: float = 16.0
    quadratic: float = 8192.0
    group_items: int = 20_000

    def cost(self, length: int) -> float:
        return self.start + length + length * length / self.quadratic


def opened(size: int, left: int, least: int, options: Packing) -> int:
    """The length to open for an item of ``size`` when ``left`` tokens remain, the smallest item ``least`` long."""
    def price(length):
        room = length - size
        return options.cost(length) / (size + (min(room, left) if left and least <= room else 0))

    return min((c for c in options.lengths if c >= size), key=lambda c: (price(c), c))


def pack(sizes: list[int], options: Packing = Packing()) -> list[tuple[int, int, int]]:
    """(sequence, its final length, position) for items given in descending size."""
    left, least = sum(sizes), min(sizes, default=0)
    rooms: list[int] = []  # distinct rooms of open sequences, ascending
    open_: dict[int, list[int]] = {}
    capacity, placed = [], []
    for size in sizes:
        left -= size
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            sequence = open_[room].pop()
            if not open_[room]:
                rooms.pop(k)
        else:
            room = opened(size, left, least, options)
            sequence = len(capacity)
            capacity.append(room)
        placed.append((sequence, capacity[sequence] - room))
        room -= size
        if room:
            if not open_.get(room):
                insort(rooms, room)
                open_[room] = []
            open_[room].append(sequence)
    used = [0] * len(capacity)
    for (sequence, position), size in zip(placed, sizes):
        used[sequence] = max(used[sequence], position + size)
    final = [min(c for c in options.lengths if c >= u) for u in used]
    return [(sequence, final[sequence], position) for sequence, position in placed]


def packed_group(group, options: Packing):
    import pyarrow as pa

    group = group.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("digest", "ascending"), ("piece", "ascending")])
    number = group.column("group")[0].as_py()
    rows = pack(group.column("n_tokens").to_pylist(), options)
    return pa.table({
        **{c: group.column(c) for c in ("doc_id", "piece", "first_token", "n_tokens")},
        "sequence_id": pa.array([(number << 32) + s for s, _, _ in rows], pa.int64()),
        "sequence_length": pa.array([c for _, c, _ in rows], pa.int32()), "position": pa.array([p for _, _, p in rows], pa.int32()),
    })


def words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long")


def best_fit(docs: DataFrame, options: Packing = Packing(), length: Column | None = None) -> DataFrame:
    """One row per piece of a document: where it starts, and its sequence, that one's length and its position there."""
    longest = max(options.lengths)
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (words() if length is None else length).alias("all_"),
        F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("digest"))
    cut = sized.select("doc_id", "all_", "digest", F.explode(F.sequence(F.lit(0), F.floor((F.greatest("all_", F.lit(1)) - 1) / longest).cast("int"))).alias("piece"))
    first = F.col("piece").cast("long") * longest
    items = cut.select("doc_id", "digest", "piece", first.alias("first_token"), F.least(F.col("all_") - first, F.lit(longest).cast("long")).alias("n_tokens"))
    groups = max(1, -(-docs.count() // options.group_items))
    grouped = items.where("n_tokens > 0").withColumn("group", F.pmod(F.xxhash64("digest", "piece"), F.lit(groups)).cast("long"))
    empty = items.where("n_tokens = 0").select("doc_id", "piece", "first_token", "n_tokens", *(F.lit(None).cast(k).alias(c) for c, k in (("sequence_id", "long"), ("sequence_length", "int"), ("position", "int"))))
    return grouped.groupBy("group").applyInArrow(lambda g: packed_group(g, options), PACKED).unionByName(empty)


@query("op7_variable_best_fit")
def op7_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))
