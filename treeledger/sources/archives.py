"""Zip archives and folders as rows, and the policy that admits them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.durable import durable, fetch
from ..operators.ordered import ordered
from ..options import ArchiveOptions

MEMBERS = ("archive string, position long, member string, size long, compressed long, "
           "mode int, is_dir boolean, is_link boolean, is_encrypted boolean, error string")
CONTENTS = "archive string, member string, mode int, payload binary"


def folder_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file under a folder: path relative to it, size, time and bytes."""
    prefix = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(prefix)
    return found.select(
        F.regexp_replace("path", "^.*?" + _quoted(prefix) + "/", "").alias("path"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("content").alias("payload"),
    )


def _quoted(text: str) -> str:
    return "\\Q" + text.split(":", 1)[-1] + "\\E"


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Zip files of a folder as (archive, payload)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    return found.select(F.col("path").alias("archive"), F.col("modificationTime").alias("mtime"), F.col("content").alias("payload"))


def _listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in MEMBERS.split(", ")]
    for batch in batches:
        rows = []
        for archive, payload in zip(batch["archive"], batch["payload"]):
            try:
                infos = zipfile.ZipFile(io.BytesIO(payload)).infolist()
            except zipfile.BadZipFile as exc:
                rows.append((archive, None, None, None, None, None, None, None, None, f"not a valid zip archive: {exc}"))
                continue
            for position, info in enumerate(infos):
                mode = info.external_attr >> 16
                rows.append((archive, position, info.filename, info.file_size, info.compress_size, mode & 0o777,
                             info.is_dir(), (mode & 0o170000) == 0o120000, bool(info.flag_bits & 1), None))
        yield pd.DataFrame(rows, columns=names)


def list_members(zips: DataFrame) -> DataFrame:
    """One row per member from the central directory; nothing is unpacked here."""
    return zips.select("archive", "payload").mapInPandas(_listing, MEMBERS)


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive, payload in zip(batch["archive"], batch["payload"]):
            with zipfile.ZipFile(io.BytesIO(payload)) as zf:
                for info in zf.infolist():
                    if info.is_dir() or info.flag_bits & 1:
                        continue
                    yield pd.DataFrame({"archive": [archive], "member": [info.filename],
                                        "mode": [0o755 if (info.external_attr >> 16) & 0o111 else 0o644],
                                        "payload": [zf.read(info)]})


def expand_members(zips: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Contents of the kept members of admitted archives (a link's content is its target).

    The verdicts have bounded every archive unpacked here. Archive names go to the
    bytes, not the bytes to a shuffle.
    """
    admitted = durable(verdicts.where(F.col("reject_reason").isNull()).select("archive"))
    opened = fetch(zips.select("archive", "payload"), admitted, ["archive"], "left_semi").mapInPandas(_unpack, CONTENTS)
    return opened.where(skip_reason(F.col("member")).isNull()).withColumn("member", F.replace(F.col("member"), F.lit("\\"), F.lit("/")))


def unsafe_member(member: Column) -> Column:
    """Absolute, climbing, or drive-letter member names."""
    path = F.replace(member, F.lit("\\"), F.lit("/"))
    return (member == "") | member.startswith("/") | member.startswith("\\") | path.rlike(r"(^|/)\.\.(/|$)") | path.rlike("^[^/]*:")


def skip_reason(member: Column) -> Column:
    """Why one member is left out; null when it is kept."""
    return (
        F.when(member.startswith("__MACOSX/") | (paths.basename(F.regexp_replace(member, "/$", "")) == ".DS_Store"), "metadata")
        .when(unsafe_member(member), "unsafe path")
    )


def archive_verdicts(members: DataFrame, options: ArchiveOptions = ArchiveOptions()) -> DataFrame:
    """One row per archive with its counts and the first reason to refuse it."""
    sums = members.groupBy("archive").agg(
        F.first("error", ignorenulls=True).alias("error"), F.count("member").alias("entries"),
        F.sum("size").alias("bytes"), F.sum("compressed").alias("compressed"),
        F.max(F.col("is_encrypted") & skip_reason(F.col("member")).isNull()).alias("encrypted"),
    )
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("entries") > options.max_files,
              F.concat(F.lit("archive has "), F.col("entries"), F.lit(f" entries (limit {options.max_files})")))
        .when(F.col("bytes") > options.max_bytes, F.lit("archive expands past the size limit"))
        .when(F.col("encrypted"), F.lit("archive is password protected"))
    )
    ratio = F.when(F.col("compressed") > 0, F.col("bytes") / F.col("compressed")).otherwise(F.lit(0.0))
    return sums.select("archive", "entries", "bytes", ratio.alias("compression_ratio"), reason.alias("reject_reason"))


def split_archives(zips: DataFrame, options: ArchiveOptions = ArchiveOptions()) -> tuple[DataFrame, DataFrame]:
    """(admitted, refused) archives, the refused with their reason: the dead-letter split."""
    verdicts = durable(archive_verdicts(list_members(zips), options))
    return verdicts.where(F.col("reject_reason").isNull()), verdicts.where(F.col("reject_reason").isNotNull())


def group_quota(rows: DataFrame, keys: list[str], size: Column, max_rows: int, max_bytes: int) -> DataFrame:
    """The archive limits on any grouped table: counts per group and a reject reason."""
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), F.sum(size).alias("bytes"))
    return sums.withColumn(
        "reject_reason",
        F.when(F.col("entries") > max_rows, F.concat(F.lit("has "), F.col("entries").cast("string"), F.lit(f" entries (limit {max_rows})")))
        .when(F.col("bytes") > max_bytes, F.concat(F.lit("holds "), F.col("bytes").cast("string"), F.lit(f" bytes (limit {max_bytes})"))),
    )


def strip_common_root(files: DataFrame) -> DataFrame:
    """Lift one lone wrapping folder off every version that has exactly one.

    The per-version test is a min/max pair over first segments, which Spark
    combines before the shuffle: one distinct first segment and no file at the root.
    """
    version = ["artifact", "seq"]
    first = F.split("path", "/").getItem(0)
    roots = files.groupBy(*version).agg(
        F.min(first).alias("_lo"), F.max(first).alias("_hi"), F.min(paths.depth(F.col("path"))).alias("_depth")
    ).where((F.col("_lo") == F.col("_hi")) & (F.col("_depth") > 0)).select(*version, F.col("_lo").alias("wrapper"))
    roots = durable(roots)
    lifted = F.substring(F.col("path"), F.length("wrapper") + 2, F.length("path"))
    return fetch(files, roots, version, "left").withColumn(
        "path", F.when(F.col("wrapper").isNotNull(), lifted).otherwise(F.col("path")))


def top_level(files: DataFrame) -> DataFrame:
    """Distinct first path segments per version in first-seen order of ``position``."""
    heads = files.select("artifact", "seq", F.split(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "/").getItem(0).alias("entry"), "position")
    firsts = heads.where((F.col("entry") != "") & ~F.col("entry").startswith("__MACOSX")).groupBy(
        "artifact", "seq", "entry").agg(F.min("position").alias("first_at"))
    return ordered(firsts, ["artifact", "seq"], [F.col("first_at"), F.col("entry")], number="position").drop("first_at")
