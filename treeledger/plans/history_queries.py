"""Arrivals, numbering, selection, retention, merging and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrivals as arrival_ops
from ..operators import history, identity
from ..sources import adapters
from .registry import query

table = adapters.table
ARRIVALS = adapters.ARRIVALS_SQL
OUTCOMES_SQL = f"""
a AS ({ARRIVALS}),
dup AS (SELECT *, row_number() OVER (PARTITION BY archive_key ORDER BY ts, event_id) > 1 AS is_dup FROM a),
tr AS (SELECT *, row_number() OVER (PARTITION BY artifact, tree_key ORDER BY ts, event_id) = 1 AS is_first FROM dup WHERE NOT is_dup),
nu AS (SELECT artifact, tree_key, row_number() OVER (PARTITION BY artifact ORDER BY ts, event_id) AS seq FROM tr WHERE is_first),
oc AS (SELECT d.event_id, d.ts, d.artifact, d.kind, CASE WHEN d.is_dup THEN 'duplicate-download' WHEN is_first THEN 'new' ELSE 'unchanged' END AS status, nu.seq
  FROM dup d LEFT JOIN tr ON tr.event_id = d.event_id LEFT JOIN nu ON nu.artifact = tr.artifact AND nu.tree_key = tr.tree_key)"""


def outcomes(spark, sf):
    return history.ingest_outcomes(adapters.arrivals(spark, sf)).select("event_id", "ts", "artifact", "kind", "status", "seq")


@query("ingest_outcomes", f"WITH {OUTCOMES_SQL} SELECT * FROM oc")
def ingest_outcomes(spark, sf):
    return outcomes(spark, sf)


@query("backfill_outcome_counts", f"WITH {OUTCOMES_SQL} SELECT status, count(*) AS arrivals FROM oc GROUP BY status")
def backfill_outcome_counts(spark, sf):
    return history.outcome_counts(outcomes(spark, sf))


@query("seen_counters", f"SELECT archive_key, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS times_seen, first(kind ORDER BY ts, event_id) AS source_name FROM ({ARRIVALS}) GROUP BY archive_key")
def seen_counters(spark, sf):
    return history.seen_counters(adapters.arrivals(spark, sf))


@query("first_last_seen", f"SELECT artifact, min(ts) AS first_seen, max(ts) AS last_seen FROM ({ARRIVALS}) GROUP BY artifact")
def first_last_seen(spark, sf):
    return history.first_last_seen(adapters.arrivals(spark, sf))


@query("artifact_list", """
SELECT c_custkey AS artifact, c_name AS name, count(o_orderkey) AS version_count, max(o_orderkey) AS latest_seq
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def artifact_list(spark, sf):
    """Orders are reduced to one row per customer before they meet the customers."""
    per = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("artifact")).agg(
        F.count(F.lit(1)).alias("version_count"), F.max("o_orderkey").alias("latest_seq"))
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("artifact"), F.col("c_name").alias("name"))
    return names.join(per, "artifact", "left").withColumn("version_count", F.coalesce("version_count", F.lit(0)))


@query("archive_totals", """
SELECT (SELECT count(*) FROM customer) AS artifacts, (SELECT count(*) FROM orders) AS versions, (SELECT CAST(coalesce(sum(CAST(o_totalprice AS BIGINT)), 0) AS BIGINT) FROM orders) AS bytes""")
def archive_totals(spark, sf):
    versions = table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("versions"), F.coalesce(F.sum(F.rint("o_totalprice").cast("bigint")), F.lit(0)).alias("bytes"))
    one_row = table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("artifacts"))
    return one_row.withColumn("_k", F.lit(1)).join(versions.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("version_steps", f"SELECT artifact, old_seq, seq AS new_seq FROM (SELECT artifact, seq, lag(seq) OVER (PARTITION BY artifact ORDER BY seq) AS old_seq FROM ({adapters.TURNS_SQL})) WHERE old_seq IS NOT NULL")
def version_steps(spark, sf):
    return history.version_steps(adapters.turns(spark, sf))


@query("latest_version", f"SELECT artifact, seq, role FROM ({adapters.TURNS_SQL}) QUALIFY row_number() OVER (PARTITION BY artifact ORDER BY seq DESC) = 1")
def latest_version(spark, sf):
    return history.latest_version(adapters.turns(spark, sf), ["seq", "role"])


@query("retention_keep", f"SELECT artifact, seq, role FROM ({adapters.TURNS_SQL}) QUALIFY row_number() OVER (PARTITION BY artifact ORDER BY seq DESC) <= 2")
def retention_keep(spark, sf):
    return history.retention(adapters.turns(spark, sf).select("artifact", "seq", "role"), 2)


_ORDERS = "SELECT o_custkey AS artifact, o_orderkey AS seq, o_orderdate AS ingested_at, o_orderstatus AS runtime, o_orderpriority AS handler, CAST(floor(o_totalprice) AS BIGINT) AS total_size FROM orders"


def order_versions(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("artifact"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("ingested_at"),
        F.col("o_orderstatus").alias("runtime"), F.col("o_orderpriority").alias("handler"), F.floor("o_totalprice").cast("bigint").alias("total_size"))


@query("merge_renumber", f"""
WITH v AS ({_ORDERS}), m AS (SELECT *, artifact AS origin, CASE WHEN artifact % 10 = 3 THEN artifact - 3 ELSE artifact END AS target FROM v),
t AS (SELECT DISTINCT c_custkey - 3 AS target FROM customer WHERE c_custkey % 10 = 3)
SELECT m.target AS artifact, origin, seq, CASE WHEN t.target IS NULL THEN seq ELSE row_number() OVER (PARTITION BY m.target ORDER BY ingested_at, seq) END AS new_seq
FROM m LEFT JOIN t ON t.target = m.target""")
def merge_renumber(spark, sf):
    mapping = table(spark, sf, "customer").where(F.col("c_custkey") % 10 == 3).select(
        F.col("c_custkey").alias("source"), (F.col("c_custkey") - 3).alias("target"))
    merged = history.merge_artifacts(order_versions(spark, sf), mapping, ["ingested_at", "seq"])
    return merged.select("artifact", "origin", "seq", "new_seq")


@query("heal_sequence_collisions", f"""
WITH v AS (SELECT artifact, seq AS id, seq % 40 AS seq, ingested_at FROM ({_ORDERS})),
b AS (SELECT artifact FROM v GROUP BY artifact HAVING count(DISTINCT seq) <> count(*) OR min(seq) = 0)
SELECT v.artifact, id, seq, CASE WHEN b.artifact IS NULL THEN seq ELSE row_number() OVER (PARTITION BY v.artifact ORDER BY ingested_at, seq, id) END AS new_seq, b.artifact IS NOT NULL AS healed
FROM v LEFT JOIN b ON b.artifact = v.artifact""")
def heal_sequence_collisions(spark, sf):
    versions = order_versions(spark, sf).select("artifact", F.col("seq").alias("id"), (F.col("seq") % 40).alias("seq"), "ingested_at")
    healed = history.heal_collisions(versions, ["ingested_at", "seq", "id"])
    return healed.select("artifact", "id", "seq", "new_seq", "healed")


_SELECTOR_CASE = "CASE c_custkey % 9 WHEN 0 THEN 'latest' WHEN 1 THEN ' First ' WHEN 2 THEN '-2' WHEN 3 THEN 'v' || c_custkey WHEN 4 THEN NULL WHEN 5 THEN 'newest' WHEN 6 THEN '-30' WHEN 7 THEN 'HEAD' ELSE 'v' || (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) END"


@query("resolve_selectors", f"""
WITH v AS (SELECT artifact, seq, row_number() OVER (PARTITION BY artifact ORDER BY seq DESC) AS place, count(*) OVER (PARTITION BY artifact) AS n FROM ({_ORDERS})),
s AS (SELECT c_custkey AS artifact, {_SELECTOR_CASE} AS selector, 1 AS default_offset FROM customer),
t AS (SELECT *, lower(trim(selector)) AS t, regexp_replace(lower(trim(selector)), '^v', '') AS b, (SELECT max(n) FROM v WHERE v.artifact = s.artifact) AS n FROM s),
k AS (SELECT *, CASE WHEN regexp_full_match(b, '[+-]?[0-9]+') THEN CAST(b AS BIGINT) END AS num FROM t),
r AS (SELECT k.*, CASE WHEN n IS NULL THEN NULL WHEN selector IS NULL THEN (SELECT seq FROM v WHERE v.artifact = k.artifact AND place = least(default_offset + 1, k.n))
    WHEN t IN ('latest', 'last', 'head') THEN (SELECT max(seq) FROM v WHERE v.artifact = k.artifact) WHEN t IN ('first', 'oldest') THEN (SELECT min(seq) FROM v WHERE v.artifact = k.artifact)
    WHEN num < 0 THEN (SELECT seq FROM v WHERE v.artifact = k.artifact AND place = -num) ELSE (SELECT seq FROM v WHERE v.artifact = k.artifact AND seq = num) END AS seq FROM k)
SELECT artifact, selector, default_offset, seq, CASE WHEN n IS NULL THEN 'no versions' WHEN selector IS NULL OR t IN ('latest', 'last', 'head', 'first', 'oldest') THEN NULL
  WHEN num IS NULL THEN 'not understood' WHEN num < 0 AND seq IS NULL THEN 'only ' || n || ' versions' WHEN seq IS NULL THEN 'not found' END AS reason FROM r""")
def resolve_selectors(spark, sf):
    versions = order_versions(spark, sf).select("artifact", "seq")
    key = F.col("c_custkey")
    oldest = versions.groupBy("artifact").agg(F.min("seq").alias("_oldest"))
    selectors = table(spark, sf, "customer").select(key, key.alias("artifact")).join(oldest, "artifact", "left").select(
        "artifact",
        F.when(key % 9 == 0, "latest").when(key % 9 == 1, " First ").when(key % 9 == 2, "-2").when(key % 9 == 3, F.concat(F.lit("v"), key))
        .when(key % 9 == 4, F.lit(None)).when(key % 9 == 5, "newest").when(key % 9 == 6, "-30").when(key % 9 == 7, "HEAD")
        .otherwise(F.concat(F.lit("v"), "_oldest")).alias("selector"), F.lit(1).alias("default_offset"))
    return history.resolve_selectors(versions, selectors)


@query("timeline", f"""
SELECT artifact, seq, lag(seq) OVER w AS previous_seq, total_size, total_size - lag(total_size) OVER w AS delta, total_size - first_value(total_size) OVER w AS delta_first,
  coalesce(lag(runtime) OVER w <> runtime, false) AS runtime_moved, coalesce(lag(handler) OVER w <> handler, false) AS handler_moved
FROM ({_ORDERS}) WINDOW w AS (PARTITION BY artifact ORDER BY seq)""")
def timeline(spark, sf):
    return history.timeline(order_versions(spark, sf), "total_size", ["runtime", "handler"])


@query("missing_steps", f"""
WITH st AS (SELECT artifact, lag(seq) OVER (PARTITION BY artifact ORDER BY seq) AS old_seq, seq AS new_seq FROM ({adapters.TURNS_SQL}))
SELECT artifact, old_seq, new_seq FROM st WHERE old_seq IS NOT NULL AND NOT ((artifact + new_seq) % 3 = 0)""")
def missing_steps(spark, sf):
    steps = history.version_steps(adapters.turns(spark, sf))
    done = steps.where((F.col("artifact") + F.col("new_seq")) % 3 == 0)
    return history.missing_steps(steps, done)


@query("missing_steps_by_engine", f"""
WITH st AS (SELECT artifact, lag(seq) OVER (PARTITION BY artifact ORDER BY seq) AS old_seq, seq AS new_seq FROM ({adapters.TURNS_SQL}))
SELECT artifact, old_seq, new_seq FROM st WHERE old_seq IS NOT NULL AND NOT ((artifact + new_seq) % 3 = 0 AND new_seq % 2 = 0)""")
def missing_steps_by_engine(spark, sf):
    """Steps that another engine may have finished, but not this one."""
    steps = history.version_steps(adapters.turns(spark, sf))
    done = steps.where((F.col("artifact") + F.col("new_seq")) % 3 == 0).withColumn("engine", F.when(F.col("new_seq") % 2 == 0, "a").otherwise("b"))
    return history.missing_steps(steps, done, engine="a")


@query("latest_headlines", f"""
WITH st AS (SELECT artifact, lag(seq) OVER (PARTITION BY artifact ORDER BY seq) AS old_seq, seq AS new_seq FROM ({adapters.TURNS_SQL})),
l AS (SELECT * FROM st WHERE old_seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY artifact ORDER BY new_seq DESC) = 1)
SELECT a.artifact, l.old_seq, l.new_seq, CASE WHEN a.artifact % 3 <> 0 THEN 'step ' || old_seq || ' to ' || new_seq END AS headline, CASE WHEN a.artifact % 3 <> 0 AND l.old_seq IS NOT NULL THEN 'low' END AS risk
FROM (SELECT DISTINCT conv_id AS artifact FROM conversations) a LEFT JOIN l ON l.artifact = a.artifact""")
def latest_headlines(spark, sf):
    turns = adapters.turns(spark, sf)
    steps = history.version_steps(turns)
    records = steps.withColumn("status", F.when(F.col("artifact") % 3 != 0, "done").otherwise("pending")).withColumn(
        "headline", F.concat(F.lit("step "), "old_seq", F.lit(" to "), "new_seq")).withColumn("risk", F.lit("low"))
    return history.latest_headlines(turns.select("artifact").distinct(), steps, records)


@query("stale_status", """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND (TIMESTAMP '2024-01-15 00:00:00' - ts > INTERVAL 1200 SECONDS) THEN 'failed' WHEN event_type IN ('click', 'view') THEN 'pending' ELSE 'done' END AS status FROM events""")
def stale_status(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", F.when(F.col("event_type").isin("click", "view"), "pending").otherwise("done").alias("status"))
    as_of = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    stale = (F.col("status") == "pending") & history.is_stale(F.col("ts"), as_of)
    return e.select("event_id", F.when(stale, "failed").otherwise(F.col("status")).alias("status"))


# Regular expressions over customer files, made from the nations: escapes, classes, groups, quantifiers, alternatives.
_NAMED = "c_name || '-' || c_mktsegment || '.zip'"
_PATTERN = """CASE n_nationkey % 6 WHEN 0 THEN '0' || n_nationkey || '[0-9]-\\x41UTO' WHEN 1 THEN '^Customer#0+' || n_nationkey || '\\D' WHEN 2 THEN '(MACH|FURN)[A-Z]*\\.z'
  WHEN 3 THEN n_nationkey || '-BUILDINGS?\\.zip$' WHEN 4 THEN n_nationkey || '.?-HOUSE+HOLD' ELSE '0' || n_nationkey || '-H|0' || (n_nationkey + 1) || '-A' END"""


@query("regex_alias_match", f"""
WITH f AS (SELECT c_custkey AS id, {_NAMED} AS name FROM customer), p AS (SELECT n_nationkey AS alias_id, n_name AS artifact, {_PATTERN} AS pattern FROM nation)
SELECT id, min(alias_id) AS alias_id, arg_min(artifact, alias_id) AS artifact FROM f, p WHERE regexp_matches(name, pattern) GROUP BY id""")
def regex_alias_match(spark, sf):
    aliases = table(spark, sf, "nation").selectExpr("n_nationkey AS alias_id", "n_name AS artifact", _PATTERN.replace("\\", "\\\\") + " AS pattern", "true AS is_regex")
    return identity.alias_match(table(spark, sf, "customer").selectExpr("c_custkey AS id", _NAMED + " AS name"), aliases)
