"""A dataset manifest: every row a leaf, a tree of threes per source, and a root over the sources.

Leaves of a source ascend by doc_id. While a source has several nodes, every three consecutive
ones (the last run: fewer, even one) become their digest; what remains is the source's subroot.
Subroots, null source first and the others bytewise, are treated likewise and give the root.

Aligned blocks of 3^DEPTH nodes are rows, and a block keeps each of its levels as one string of
fixed-width hex digests: parents are digests of substrings three digests wide, and the siblings
of a node are the two substrings that flank it in its run. Block roots are the leaves of the next
round, so a source of any size takes a few rounds of bounded rows. Rows get their places from one
sort on the full order, so a source that holds a third of all rows is spread like any other.

A row's path is the list of (left, right) siblings from its leaf to the root: folding a leaf along
it gives the root again, and a leaf made from altered columns gives another.

Nulls in any column are part of the leaf (``-``); a null doc_id comes first in its source and
equal doc_ids are ordered by leaf; rows equal in every column of the leaf are leaves of their own;
empty and very long texts are digested whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.ranks import number
from treeledger.llm.registry import query
from treeledger.llm.sharding import CRC_SQL
from treeledger.operators.durable import durable
from treeledger.sources.adapters import table

DEPTH = 5
WIDE = 64  # hex digits of a digest
RUN = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
POWERS = [RUN**k for k in range(39)]


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(changed: dict[str, Column] | None = None) -> Column:
    """Digest of a row's columns, some of them replaced."""
    return digest(*(field((changed or {}).get(c, F.col(c))) for c in COLUMNS))


def levels_above(nodes: Column) -> Column:
    """How many levels lead from so many nodes to one."""
    return F.size(F.filter(F.array(*map(F.lit, POWERS)), lambda p: p < nodes))


def parents(level: Column) -> Column:
    """The next level of a level, both as strings of digests."""
    runs = F.ceil(F.length(level) / (RUN * WIDE)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda k: F.sha2(F.substring(level, k * RUN * WIDE + 1, F.lit(RUN * WIDE)), 256)), "")


def blocks(nodes: DataFrame, depth: int) -> DataFrame:
    """Rows of up to 3^depth nodes (group, at, of, digest, more): group, block, of, members, levels, top."""
    size = RUN**depth
    gathered = nodes.withColumn("block", F.expr(f"at div {size}")).groupBy("group", "block").agg(
        F.first("of").alias("of"), F.sort_array(F.collect_list(F.struct("at", "digest", "more"))).alias("members"))

    def raised(levels: Column, k: Column) -> Column:
        return F.when(k <= levels_above(F.col("of")), F.concat(levels, F.array(parents(F.element_at(levels, -1))))).otherwise(levels)

    lowest = F.array(F.array_join(F.transform("members", lambda m: m["digest"]), ""))
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), lowest, raised)
    return gathered.withColumn("levels", levels).withColumn("top", F.element_at("levels", -1))


def siblings(levels: Column, top: Column, at: Column) -> Column:
    """(left, right) of the ``at``-th node of a block on each level below its top."""
    def flanks(level: Column, k: Column) -> Column:
        place = F.floor(at / F.element_at(F.array(*map(F.lit, POWERS[:16])), k + 1))
        run, own = F.floor(place / RUN), F.pmod(place, F.lit(RUN))
        start = (run * RUN * WIDE).cast("int") + 1
        before = (own * WIDE).cast("int")
        return F.struct(
            F.substring(level, start, before).alias("left"),
            F.substring(level, start + before + WIDE, F.lit((RUN - 1) * WIDE) - before).alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), flanks)


def nodes_of(climbed: DataFrame) -> DataFrame:
    """group, at, digest, more, subroot, root, path of every member of climbed blocks."""
    def member(m: Column, k: Column) -> Column:
        return F.struct(
            m["at"].alias("at"), m["digest"].alias("digest"), m["more"].alias("more"),
            F.concat(siblings(F.col("levels"), F.col("top"), k), F.col("path")).alias("path"))

    return climbed.select("group", "subroot", "root", F.inline(F.transform("members", member)))


def climb(nodes: DataFrame, depth: int, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Blocks of ``nodes`` with what lies above each: subroot, root and path from the block's top to the root.

    ``above`` gets group and subroot, one row per group, and adds root and path.
    """
    stored = durable(blocks(nodes, depth))
    if (stored.agg(F.max("of")).first()[0] or 0) <= RUN**depth:
        upper = above(stored.select("group", F.col("top").alias("subroot"))).withColumn("block", F.lit(0).cast("long"))
    else:
        tops = stored.select("group", F.col("block").alias("at"), F.ceil(F.col("of") / RUN**depth).alias("of"), F.col("top").alias("digest"), F.lit(None).cast("string").alias("more"))
        upper = nodes_of(climb(tops, depth, above)).select("group", F.col("at").alias("block"), "subroot", "root", "path")
    return stored.join(upper, ["group", "block"])


def placed(df: DataFrame, order: list[str], groups: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``at`` and ``of`` along one global sort, whose stored partitions are the slices that are numbered."""
    cut = durable(df.orderBy(*groups, *order).withColumn("slice_", F.spark_partition_id()))
    return number(cut, F.col("slice_"), [F.col(c) for c in order], groups, "at", "of").drop("slice_")


def over_sources(depth: int) -> Callable[[DataFrame], DataFrame]:
    """The tree over the subroots of all sources."""
    def above(tops: DataFrame) -> DataFrame:
        ranked = placed(tops, ["group"]).select(F.lit("").alias("group"), "at", "of", F.col("subroot").alias("digest"), F.col("group").alias("more"))
        none = F.expr("cast(array() as array<struct<left:string,right:string>>)")
        climbed = climb(ranked, depth, lambda root: root.withColumn("root", F.col("subroot")).withColumn("path", none))
        return nodes_of(climbed).select(F.col("more").alias("group"), F.col("digest").alias("subroot"), "root", "path")

    return above


def manifest(docs: DataFrame, changed: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """doc_id, source, at, leaf, changed_leaf, subroot, root, path for every row of ``docs``.

    ``changed`` replaces the text of a row where it is not null; ``changed_leaf`` is the leaf
    of the row so altered, null where the text stays. ``path`` lists the siblings of the original.
    """
    edited = F.lit(None).cast("string") if changed is None else changed
    rows = docs.select(
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("group"), "doc_id", leaf().alias("digest"),
        F.when(edited.isNotNull() & (edited != F.col("text")), leaf({"text": edited})).alias("changed_leaf"))
    ranked = placed(durable(rows), ["doc_id", "digest"], ("group",))
    leaves = ranked.select("group", "at", "of", "digest", F.struct("doc_id", "changed_leaf").alias("more"))
    return nodes_of(climb(leaves, depth, over_sources(depth))).select(
        "more.doc_id", F.when(F.col("group") != "n", F.substring("group", 2, 2**31 - 1)).alias("source"), "at", F.col("digest").alias("leaf"),
        "more.changed_leaf", "subroot", "root", "path")


def proof(path: Column) -> Column:
    """All siblings of a path as one string, left to right and level by level."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def field_sql(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(field_sql(text if c == "text" else c) for c in COLUMNS) + ")"


def climb_sql(name: str, source: str) -> str:
    """CTEs of all levels over ``source`` (g, nodes: list): <name>(g, level, nodes)."""
    return f"""
{name} AS (
  SELECT g, 0 AS level, nodes FROM {source}
  UNION ALL
  SELECT g, level + 1, list_transform(range((len(nodes) + 2) // 3), lambda k: sha256(array_to_string(nodes[3 * k + 1 : 3 * k + 3], '')))
  FROM {name} WHERE len(nodes) > 1
)"""


SIBLINGS_SQL = "array_to_string(nodes[pos // {w} // 3 * 3 + 1 : pos // {w}], '') AS l, array_to_string(nodes[pos // {w} + 2 : pos // {w} // 3 * 3 + 3], '') AS r"
MANIFEST_SQL = f"""
WITH RECURSIVE {CRC_SQL},
crc AS (
  SELECT id, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
    lambda c, b: xor(c // 256, entries[(xor(c % 256, b)) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
  FROM (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL), crc_table
),
rows_ AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS g, {leaf_sql("text")} AS leaf,
    CASE WHEN crc % 2 = 0 THEN {leaf_sql("replace(text, chr(10), '')")} ELSE {leaf_sql("text")} END AS given
  FROM documents LEFT JOIN crc ON doc_id = id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows_),
lists AS (SELECT g, list(leaf ORDER BY pos) AS nodes FROM ranked GROUP BY g),
{climb_sql("low", "lists")},
subroots AS (SELECT g, nodes[1] AS subroot FROM low WHERE len(nodes) = 1),
source_list AS (SELECT '' AS g, list(subroot ORDER BY g) AS nodes FROM subroots),
{climb_sql("high", "source_list")},
source_at AS (SELECT g, subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM subroots),
segments AS (
  SELECT r.g, r.pos, l.level, {SIBLINGS_SQL.format(w="CAST(3 ** l.level AS BIGINT)")} FROM ranked r JOIN low l ON r.g = l.g AND len(l.nodes) > 1
),
upper_segments AS (
  SELECT s.g, 1000 + h.level AS level, {SIBLINGS_SQL.format(w="CAST(3 ** h.level AS BIGINT)")} FROM source_at s, high h WHERE len(h.nodes) > 1
),
paths AS (
  SELECT g, pos, list({{'l': l, 'r': r}} ORDER BY level) AS path FROM (
    SELECT * FROM segments UNION ALL SELECT r.g, r.pos, u.level, u.l, u.r FROM ranked r JOIN upper_segments u ON r.g = u.g) GROUP BY g, pos
),
fold AS (
  SELECT r.g, r.pos, 1 AS step, r.given AS node, coalesce(p.path, []) AS path FROM ranked r LEFT JOIN paths p ON r.g = p.g AND r.pos = p.pos
  UNION ALL
  SELECT g, pos, step + 1, sha256(path[step].l || node || path[step].r), path FROM fold WHERE step <= len(path)
)
SELECT r.doc_id, r.leaf, s.subroot, h.nodes[1] AS root, sha256(array_to_string(list_transform(f.path, lambda s: s.l || s.r), '')) AS proof_sha256,
  f.node AS folded_root, f.node = h.nodes[1] AS verified
FROM ranked r JOIN subroots s ON r.g = s.g JOIN fold f ON r.g = f.g AND r.pos = f.pos AND f.step = len(f.path) + 1, (SELECT nodes FROM high WHERE len(nodes) = 1) h
"""


@query("op11_merkle_manifest", MANIFEST_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    unbroken = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", ""))
    rows = manifest(table(spark, sf_dir, "documents"), unbroken)
    given = rows.withColumn("folded_root", folded(F.coalesce("changed_leaf", "leaf"), F.col("path")))
    return given.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
