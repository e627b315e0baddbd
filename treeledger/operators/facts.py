"""Per-file facts, the content identity of a version, and per-version totals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..options import ArchiveOptions, ScanOptions
from .durable import durable, fetch
from .ordered import ordered

VERSION = ["artifact", "seq"]
TREE_FAN = 4096


def file_facts(files: DataFrame, options: ScanOptions = ScanOptions(), keep_content: bool = False) -> DataFrame:
    """One row per file: size, hash, language, vendored and text flags, lines.

    ``files`` holds (artifact, seq, path, content, mode) with text content; where a scan
    limit is set, a larger file is hashed but not read for text facts.
    """
    content, lang = F.col("content"), paths.language_label(F.col("path"))
    size = F.octet_length(content).cast("bigint")
    readable = (lang != "binary") & ~F.contains(content, F.lit("\x00"))
    if options.max_scan_bytes is not None:
        readable = readable & (size <= options.max_scan_bytes)
    return files.select(
        "artifact", "seq", "path", size.alias("size"), F.sha2(content, 256).alias("sha256"),
        F.col("mode").cast("int").alias("mode"), readable.alias("is_text"),
        paths.is_vendored(F.col("path"), options.vendor_globs).alias("is_vendor"), lang.alias("lang"),
        F.when(readable, text.line_count(content)).otherwise(F.lit(0).cast("bigint")).alias("lines"),
        *(["content"] if keep_content else []),
    )


def _hash_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feed (artifact, seq, entry) rows, already in order, through one digest per version."""
    current, digest, types = None, None, None

    def row(key: tuple, value: str) -> pa.RecordBatch:
        arrays = [pa.array([v], t) for v, t in zip((*key, value), (*types, pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names=[*VERSION, "tree_hash"])

    for batch in batches:
        types = [batch.schema.field(c).type for c in VERSION]
        columns = batch.to_pydict()
        for artifact, seq, entry in zip(columns["artifact"], columns["seq"], columns["entry"]):
            if (artifact, seq) != current:
                if current is not None:
                    yield row(current, digest.hexdigest())
                current, digest = (artifact, seq), hashlib.sha256(entry.encode())
            else:
                digest.update(b"\n")
                digest.update(entry.encode())
    if current is not None:
        yield row(current, digest.hexdigest())


def tree_hash(facts: DataFrame, options: ArchiveOptions = ArchiveOptions()) -> DataFrame:
    """Content identity of each version: SHA-256 over its sorted ``sha  path`` lines.

    Versions within the archive file limit are hashed in the JVM from an array of
    known bounded length. Larger ones are sorted by Spark (spilling to disk) and
    streamed through a digest in constant memory, giving the same value.
    """
    entries = facts.select(*VERSION, "path", "sha256")
    large = durable(entries.groupBy(*VERSION).count().where(F.col("count") > options.max_files).select(*VERSION))
    any_large = not large.isEmpty()
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))),
                        lambda e: F.concat(e["sha256"], F.lit("  "), e["path"]))
    small = fetch(entries, large, VERSION, "left_anti") if any_large else entries
    usual = small.groupBy(*VERSION).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("tree_hash"))
    if not any_large:
        return usual
    types = dict(entries.dtypes)
    streamed = (
        fetch(entries, large, VERSION, "left_semi")
        .select(*VERSION, "path", F.concat("sha256", F.lit("  "), "path").alias("entry"))
        .repartition(*VERSION)
        .sortWithinPartitions(*VERSION, "path")
        .select(*VERSION, "entry")
        .mapInArrow(_hash_sorted, f"artifact {types['artifact']}, seq {types['seq']}, tree_hash string")
    )
    return usual.unionByName(streamed)


def _level(nodes: DataFrame, fan: int, leaves: bool) -> DataFrame:
    """Parents of the nodes (version, at, entry, files).

    Places have no gaps, so a parent 0 with one child is over a version's only node: a root stays as it is.
    """
    children = F.array_sort(F.collect_list(F.struct("at", "entry")))
    digest = F.sha2(F.array_join(F.transform(children, lambda c: c["entry"]), "\n"), 256)
    parent = F.floor(F.col("at") / fan)
    done = F.lit(not leaves) & (F.max("at") == 0)
    return nodes.groupBy(*VERSION, parent.alias("parent")).agg(
        F.when(done, F.max("entry")).otherwise(digest).alias("entry"), F.sum("files").alias("files")).withColumnRenamed("parent", "at")


def tree_root(facts: DataFrame, fan: int = TREE_FAN) -> DataFrame:
    """Content identity of each version as a tree of digests over its sorted ``sha  path`` lines.

    Every ``fan`` consecutive lines (the last run: fewer) are joined by newlines and hashed,
    then every ``fan`` consecutive digests, until one is left. A version of any size is many
    groups of at most ``fan`` short strings, so no task or array grows with it. A version of
    at most ``fan`` files has its ``tree_hash`` as root. One row per version: files, tree_root.
    A null path or digest counts as an empty string; an empty table gives no rows.
    """
    if fan < 2:
        raise ValueError("a node must hold at least two entries")
    path, digest = (F.coalesce(c, F.lit("")) for c in ("path", "sha256"))
    lines = facts.select(*VERSION, path.alias("path"), F.concat(digest, F.lit("  "), path).alias("entry"), F.lit(1).cast("bigint").alias("files"))
    numbered = ordered(lines, VERSION, [F.col("path"), F.col("entry")], number="at").drop("path")
    level = durable(_level(numbered.withColumn("at", F.col("at") - 1), fan, leaves=True))
    last = level.agg(F.max("at")).first()[0] or 0
    while last > 0:
        level, last = _level(level, fan, leaves=False), last // fan
    return level.select(*VERSION, "files", F.col("entry").alias("tree_root"))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0).cast("bigint"))


def sum_if(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")


def version_totals(facts: DataFrame) -> DataFrame:
    own, vendored = ~F.col("is_vendor"), F.col("is_vendor")
    return facts.groupBy(*VERSION).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_size"),
        count_if(own).alias("code_file_count"), sum_if(own, F.col("size")).alias("code_size"),
        sum_if(own, F.col("lines")).alias("code_lines"),
        count_if(vendored).alias("vendor_file_count"), sum_if(vendored, F.col("size")).alias("vendor_size"),
    )


def language_breakdown(facts: DataFrame) -> DataFrame:
    """First-party files per language."""
    return facts.where(~F.col("is_vendor")).groupBy(*VERSION, "lang").agg(F.count(F.lit(1)).alias("files"))
