"""Shards that each hold the corpus mixture: proportional stratified interleaving.

Rows are shuffled by a seeded digest within their source, given the fractional rank
(2 rank + 1) / (2 rows of the source), sorted by it over all sources and cut into equal
runs. Any run then holds each source in its share of the corpus, to within one row and, for
a share p among k sources, p * k more, since ranks of other sources may fall together at a cut.

Everything is DataFrame functions. Text is reduced to its size and checksum in the scan;
only narrow rows are shuffled. Null text has size 8 and checksum 0; a null source is a
source of its own; rows that repeat in full share a law and get different slots; an empty
table gives no rows. Equal texts follow their own rows: the row law allows no group to
stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.ranks import SLICES, leading, number, seeded, seeded_sql
from treeledger.llm.registry import query
from treeledger.sources.adapters import table

SHARDS = 24
SEED = 20


def stratified_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("stratum_"),
        seeded(seed, "doc_id").alias("key_"),
    )
    ties = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = number(rows, leading(F.col("key_")), [F.col("key_"), *ties], ("stratum_",), "in_source_", "of_source_")
    fraction = (2 * F.col("in_source_") + 1) / (2 * F.col("of_source_"))
    placed = number(
        ranked.withColumn("fraction_", fraction), F.floor(F.col("fraction_") * SLICES),
        [F.col("fraction_"), F.col("key_"), *ties, F.col("stratum_")], (), "place_", "all_",
    )
    shard = F.expr(f"place_ * {shards} div all_")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "source", "size", "text_crc32", "shard",
        F.expr(f"place_ - (shard * all_ + {shards - 1}) div {shards}").alias("slot"),
    )


# CRC-32 of a byte list in SQL: the table is built from its rule, reversed polynomial 0xEDB88320.
CRC_SQL = """
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x:
    CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i)) AS entries
)"""

SHARDS_SQL = f"""
WITH {CRC_SQL},
hexed AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
digits AS (SELECT doc_id, source, h, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM hexed),
base AS (
  SELECT doc_id, source, CAST(length(h) // 2 + 8 AS BIGINT) AS size,
    xor(list_reduce(bytes, lambda c, b: xor(c // 256, entries[(xor(c % 256, b)) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32,
    CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS stratum, {seeded_sql(SEED, "doc_id")} AS k
  FROM digits, crc_table
),
ranked AS (
  SELECT *, CAST(2 * row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id, text_crc32, size) - 1 AS DOUBLE)
    / (2 * count(*) OVER (PARTITION BY stratum)) AS fraction FROM base
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, k, doc_id, text_crc32, size, stratum) - 1 AS place, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, source, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place * {SHARDS} // n AS INTEGER) AS shard,
  CAST(place - ((place * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""


@query("op8_stratified_shards", SHARDS_SQL)
def op8_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = stratified_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
