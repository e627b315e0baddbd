"""Versions as nested JSON documents, and index tables written and rebuilt from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import heal_collisions
from ..operators.ordered import ordered

PART_FILES = 10_000
FILE = "struct<path:string,size:bigint,sha256:string,mode:int,is_text:boolean,is_vendor:boolean,lang:string,lines:bigint>"
DOCUMENT = (f"artifact string, seq int, part bigint, label string, ingested_at string, files array<{FILE}>, "
            "dependencies array<struct<manager:string,name:string,version:string,source:string,is_declared:boolean>>, _corrupt string")


def to_manifests(facts: DataFrame, part_files: int = PART_FILES) -> DataFrame:
    """(artifact, seq, part, document): a version's files as JSON documents.

    A version with more than ``part_files`` files is written in parts, so no array
    grows with the version.
    """
    numbered = ordered(facts, ["artifact", "seq"], [F.col("path")], number="_n")
    parts = numbered.withColumn("part", F.floor((F.col("_n") - 1) / part_files).cast("bigint"))
    entry = F.struct("path", "size", "sha256", "mode", "is_text", "is_vendor", "lang", "lines")
    grouped = parts.groupBy("artifact", "seq", "part").agg(F.sort_array(F.collect_list(entry)).alias("files"))
    return grouped.select("artifact", "seq", "part", F.to_json(F.struct("artifact", "seq", "part", "files")).alias("document"))


def parse_manifests(documents: DataFrame, column: str = "document") -> DataFrame:
    """Documents as a nested column ``m``; a malformed one leaves null sections."""
    return documents.withColumn("m", F.from_json(column, DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))


def manifest_files(parsed: DataFrame) -> DataFrame:
    """Flat file rows; missing fields take their defaults."""
    flat = parsed.select(F.col("m.artifact").alias("artifact"), F.col("m.seq").alias("seq"), F.explode("m.files").alias("f"))
    return flat.select(
        "artifact", "seq", "f.path", F.coalesce("f.size", F.lit(0)).cast("bigint").alias("size"), "f.sha256", F.coalesce("f.mode", F.lit(420)).cast("int").alias("mode"),
        F.coalesce("f.is_text", F.lit(False)).alias("is_text"), F.coalesce("f.is_vendor", F.lit(False)).alias("is_vendor"),
        F.coalesce("f.lang", F.lit("text")).alias("lang"), F.coalesce("f.lines", F.lit(0)).cast("bigint").alias("lines"))


def manifest_dependencies(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("m.artifact").alias("artifact"), F.col("m.seq").alias("seq"), F.explode("m.dependencies").alias("d")).select("artifact", "seq", "d.*")


def corrupt_manifests(parsed: DataFrame, column: str = "document") -> DataFrame:
    """The dead-letter side of a manifest read."""
    return parsed.where(F.col("m").isNull() | F.col("m._corrupt").isNotNull()).select(column)


def rebuild_versions(parsed: DataFrame, folder: str = "folder") -> DataFrame:
    """Version rows from manifests: number from the document, else from the folder's
    leading digits, else 0; artifacts whose numbers clash are renumbered by archive time."""
    seq = F.coalesce(F.nullif(F.col("m.seq"), F.lit(0)), F.expr(f"try_cast(regexp_extract({folder}, '([0-9]+)-[^/]*$', 1) AS int)"), F.lit(0))
    owner = F.coalesce("m.artifact", F.regexp_extract(folder, r"([^/]+)/versions/[^/]*$", 1))
    rows = parsed.select(folder, owner.alias("artifact"), seq.alias("seq"), F.col("m.label").alias("label"), F.coalesce("m.ingested_at", F.lit("")).alias("ingested_at"))
    return heal_collisions(rows, ["ingested_at", "seq", folder])


def write_index(df: DataFrame, path: str, partition: str = "artifact") -> None:
    """Idempotent load: only the partitions present in ``df`` are replaced.

    No repartition by artifact comes first: each task writes what it holds, so a
    large artifact is written by many tasks.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_version(df: DataFrame, artifact: str, seq: int, path: str) -> None:
    """One version's rows, pruned to its partition, as parquet."""
    df.where((F.col("artifact") == artifact) & (F.col("seq") == seq)).write.mode("overwrite").parquet(path)
