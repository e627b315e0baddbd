"""Looking things up across every artifact and version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_paths(files: DataFrame, term: str, limit: int = 100) -> DataFrame:
    """Files whose path contains ``term`` (LIKE wildcards apply, case ignored).

    The filter runs in the scan; the top ``limit`` is kept per task and merged.
    """
    hits = files.where(F.col("path").ilike(f"%{term}%"))
    return hits.orderBy("artifact", F.col("seq").desc(), "path").limit(limit)


def search_facts(deps: DataFrame, versions: DataFrame, artifacts: DataFrame, term: str, limit: int = 200) -> DataFrame:
    """Versions that depend on a name containing ``term``, each once.

    ``deps``: version_id, manager, name, version; ``versions``: version_id, artifact_id,
    seq; ``artifacts``: artifact_id, artifact. The term filters before the joins.
    """
    hits = deps.where(F.col("name").ilike(f"%{term}%")).distinct()
    joined = hits.join(versions, "version_id").join(artifacts, "artifact_id")
    rows = joined.select("artifact", "seq", "manager", "name", "version").distinct()
    return rows.orderBy("artifact", F.col("seq").desc(), "manager", "name", "version").limit(limit)


def recent_events(events: DataFrame, artifacts: DataFrame, limit: int = 30) -> DataFrame:
    """Newest events with the artifact's name where there is one.

    The newest are picked first, so the join sees ``limit`` rows, not the log.
    """
    newest = events.orderBy(F.col("event_id").desc()).limit(limit)
    return newest.join(artifacts, "artifact", "left")


def version_summary(totals: DataFrame, deps: DataFrame, refs: DataFrame, findings: DataFrame, artifact_keys: list[str]) -> DataFrame:
    """One row per version: totals, dependency counts, names and first-party findings.

    Every layer is reduced to one row per version before it is joined. Names are
    distinct before they are collected; a version's catalogue of names is bounded by
    what one code base reads.
    """
    dep_counts = deps.groupBy(*artifact_keys).agg(
        F.sum(F.col("is_declared").cast("bigint")).alias("declared"), F.sum((~F.col("is_declared")).cast("bigint")).alias("installed"))
    names = refs.where(~F.col("is_reserved")).select(*artifact_keys, "kind", "name").distinct().groupBy(*artifact_keys).agg(
        F.sum((F.col("kind") == "env").cast("bigint")).alias("env_names"), F.sum((F.col("kind") == "service").cast("bigint")).alias("services"))
    found = findings.where(~F.col("is_vendor")).groupBy(*artifact_keys).agg(F.count(F.lit(1)).alias("findings"))
    out = totals.join(dep_counts, artifact_keys, "left").join(names, artifact_keys, "left").join(found, artifact_keys, "left")
    return out.na.fill(0, ["declared", "installed", "env_names", "services", "findings"])
