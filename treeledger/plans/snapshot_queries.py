"""Facts of files and versions, and the fate of paths between two versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as facts_ops
from ..operators import snapshot
from ..sources import adapters, archives
from .registry import query
from .scalar_queries import sql_language, sql_line_count, sql_vendored

FILES = adapters.SNAPSHOT_FILES_SQL
FACTS_SQL = f"""
SELECT artifact, seq, path, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS sha256, mode,
  NOT contains(content, chr(0)) AS is_text, {sql_vendored('path')} AS is_vendor, {sql_language('path')} AS lang,
  CAST({sql_line_count('content')} AS BIGINT) AS lines
FROM ({FILES})"""
DIFF_SQL = f"""
SELECT coalesce(o.artifact, n.artifact) AS artifact, 1 AS old_seq, 2 AS new_seq, coalesce(o.path, n.path) AS path,
  CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.sha256 <> n.sha256 THEN 'modified'
       WHEN o.mode <> n.mode THEN 'mode-changed' ELSE 'unchanged' END AS kind,
  o.size AS old_size, n.size AS new_size, o.sha256 AS old_sha, n.sha256 AS new_sha, o.mode AS old_mode, n.mode AS new_mode,
  coalesce(n.is_vendor, o.is_vendor) AS is_vendor, coalesce(n.lang, o.lang) AS lang, o.lines AS old_lines, n.lines AS new_lines
FROM (SELECT * FROM f WHERE seq = 1) o FULL OUTER JOIN (SELECT * FROM f WHERE seq = 2) n
  ON o.artifact = n.artifact AND o.path = n.path"""
EXACT_SQL = """
SELECT o.artifact, o.sha AS sha256, o.path AS old_path, n.path AS new_path FROM
 (SELECT artifact, old_sha AS sha, path, row_number() OVER (PARTITION BY artifact, old_sha ORDER BY path) AS rn FROM d WHERE kind = 'removed') o
 JOIN (SELECT artifact, new_sha AS sha, path, row_number() OVER (PARTITION BY artifact, new_sha ORDER BY path) AS rn FROM d WHERE kind = 'added') n
 ON o.artifact = n.artifact AND o.sha = n.sha AND o.rn = n.rn"""
WITH_DIFF = f"WITH f AS ({FACTS_SQL}), d AS ({DIFF_SQL})"
WITH_EXACT = f"{WITH_DIFF}, x AS ({EXACT_SQL})"


def facts(spark, sf):
    return facts_ops.file_facts(adapters.snapshot_files(spark, sf))


def diff(spark, sf):
    return snapshot.snapshot_diff(snapshot.with_roles(facts(spark, sf), 1, 2))


@query("file_facts", FACTS_SQL)
def file_facts(spark, sf):
    return facts(spark, sf)


@query("tree_hash", f"SELECT artifact, seq, sha256(string_agg(sha256 || '  ' || path, chr(10) ORDER BY path)) AS tree_hash FROM ({FACTS_SQL}) GROUP BY ALL")
def tree_hash(spark, sf):
    return facts_ops.tree_hash(facts(spark, sf))


@query("tree_root", f"""
WITH RECURSIVE e AS (SELECT artifact, seq, row_number() OVER (PARTITION BY artifact, seq ORDER BY path) - 1 AS place, sha256 || '  ' || path AS entry FROM ({FACTS_SQL})),
t AS (
  SELECT artifact, seq, e.place // 8 AS place, sha256(string_agg(entry, chr(10) ORDER BY e.place)) AS entry, count(*) AS files, (max(max(e.place)) OVER (PARTITION BY artifact, seq)) // 8 AS last
  FROM e GROUP BY artifact, seq, e.place // 8
  UNION ALL
  SELECT artifact, seq, up AS place, sha256(string_agg(entry, chr(10) ORDER BY place)), CAST(sum(files) AS BIGINT), max(last) // 8
  FROM (SELECT *, place // 8 AS up FROM t WHERE last > 0) GROUP BY artifact, seq, up)
SELECT artifact, seq, files, entry AS tree_root FROM t WHERE last = 0""")
def tree_root(spark, sf):
    """Eight entries a node, so that the supplied versions have several levels."""
    return facts_ops.tree_root(facts(spark, sf), fan=8)


@query("version_totals", f"""
SELECT artifact, seq, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size,
  count(*) FILTER (NOT is_vendor) AS code_file_count, CAST(coalesce(sum(size) FILTER (NOT is_vendor), 0) AS BIGINT) AS code_size,
  CAST(coalesce(sum(lines) FILTER (NOT is_vendor), 0) AS BIGINT) AS code_lines,
  count(*) FILTER (is_vendor) AS vendor_file_count, CAST(coalesce(sum(size) FILTER (is_vendor), 0) AS BIGINT) AS vendor_size
FROM ({FACTS_SQL}) GROUP BY ALL""")
def version_totals(spark, sf):
    return facts_ops.version_totals(facts(spark, sf))


@query("language_breakdown", f"""
SELECT artifact, seq, {sql_language('path')} AS lang, count(*) AS files FROM ({adapters.CODE_FILES_SQL})
WHERE NOT {sql_vendored('path')} GROUP BY ALL""")
def language_breakdown(spark, sf):
    return facts_ops.language_breakdown(facts_ops.file_facts(adapters.code_files(spark, sf)))


@query("group_quota_policy", f"""
SELECT artifact, seq, count(*) AS entries, CAST(sum(strlen(content)) AS BIGINT) AS bytes,
  CASE WHEN count(*) > 45 THEN 'has ' || count(*) || ' entries (limit 45)'
       WHEN sum(strlen(content)) > 60000 THEN 'holds ' || CAST(sum(strlen(content)) AS BIGINT) || ' bytes (limit 60000)' END AS reject_reason
FROM ({FILES}) GROUP BY ALL""")
def group_quota_policy(spark, sf):
    files = adapters.snapshot_files(spark, sf)
    return archives.group_quota(files, ["artifact", "seq"], F.octet_length("content"), 45, 60000)


@query("strip_common_root", f"""
WITH f AS (SELECT * REPLACE (CASE WHEN artifact < 'src2' THEN path ELSE 'pkg-' || artifact || '/' || path END AS path) FROM ({FILES})),
r AS (SELECT artifact, seq, min(string_split(path, '/')[1]) AS wrapper FROM f GROUP BY ALL
      HAVING count(DISTINCT string_split(path, '/')[1]) = 1 AND min(length(path) - length(replace(path, '/', ''))) > 0)
SELECT f.artifact, f.seq, CASE WHEN wrapper IS NOT NULL THEN substr(path, length(wrapper) + 2) ELSE path END AS path, wrapper
FROM f LEFT JOIN r ON f.artifact = r.artifact AND f.seq = r.seq""")
def strip_common_root(spark, sf):
    wrapped = F.concat(F.lit("pkg-"), "artifact", F.lit("/"), "path")
    files = adapters.snapshot_files(spark, sf).withColumn("path", F.when(F.col("artifact") < "src2", F.col("path")).otherwise(wrapped))
    return archives.strip_common_root(files).select("artifact", "seq", "path", "wrapper")


@query("snapshot_diff", f"WITH f AS ({FACTS_SQL}) {DIFF_SQL}")
def snapshot_diff(spark, sf):
    return diff(spark, sf).select(
        *snapshot.STEP, "path", "kind", F.col("old.size").alias("old_size"), F.col("new.size").alias("new_size"),
        F.col("old.sha256").alias("old_sha"), F.col("new.sha256").alias("new_sha"),
        F.col("old.mode").alias("old_mode"), F.col("new.mode").alias("new_mode"),
        snapshot.is_vendored_change().alias("is_vendor"), F.coalesce("new.lang", "old.lang").alias("lang"),
        F.col("old.lines").alias("old_lines"), F.col("new.lines").alias("new_lines"))


@query("exact_renames", f"{WITH_DIFF} {EXACT_SQL}")
def exact_renames(spark, sf):
    return snapshot.exact_renames(diff(spark, sf)).select("artifact", "sha256", "old_path", "new_path")


@query("common_paths", f"SELECT artifact, path FROM ({FILES}) WHERE seq = 1 INTERSECT SELECT artifact, path FROM ({FILES}) WHERE seq = 2")
def common_paths(spark, sf):
    """Paths of both versions; an intersection on narrow keys."""
    files = adapters.snapshot_files(spark, sf)
    old, new = (files.where(F.col("seq") == s).select("artifact", "path") for s in (1, 2))
    return old.intersect(new)
