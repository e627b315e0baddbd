"""Keyed differences, edits and deletes over orders, lineitem and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets
from ..sources import adapters
from .registry import query

table = adapters.table
OLD, NEW = adapters.fact_sets_sql("old"), adapters.fact_sets_sql("new")
KEYED_SQL = f"""
SELECT coalesce(o.artifact, n.artifact) AS artifact,
  CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS kind,
  coalesce(o.manager, n.manager) AS manager, coalesce(n.name, o.name) AS name, o.version AS old_version, n.version AS new_version,
  coalesce(o.is_declared, n.is_declared) AS is_declared
FROM ({OLD}) o FULL OUTER JOIN ({NEW}) n ON o.artifact = n.artifact AND o.manager = n.manager AND lower(o.name) = lower(n.name) AND o.is_declared = n.is_declared
WHERE o.name IS NULL OR n.name IS NULL OR coalesce(o.version, '') <> coalesce(n.version, '')"""


def keyed(spark, sf):
    return sets.keyed_diff(adapters.fact_sets(spark, sf, "old"), adapters.fact_sets(spark, sf, "new"), ["artifact"])


@query("keyed_diff", KEYED_SQL)
def keyed_diff(spark, sf):
    return keyed(spark, sf)


@query("keyed_diff_collapsed", f"""
SELECT artifact, kind, manager, name, old_version, new_version, is_declared FROM ({KEYED_SQL})
QUALIFY row_number() OVER (PARTITION BY artifact, manager, lower(name), kind, old_version, new_version ORDER BY is_declared) = 1""")
def keyed_diff_collapsed(spark, sf):
    return sets.collapse_declared(keyed(spark, sf), ["artifact"])


_LINES_OLD = "SELECT l_orderkey AS artifact, l_returnflag AS manager, 'p' || l_partkey || '-' || l_linenumber AS name, l_linestatus || l_suppkey AS version, true AS is_declared FROM lineitem WHERE l_partkey % 11 <> 0"
_LINES_NEW = "SELECT l_orderkey AS artifact, l_returnflag AS manager, 'p' || l_partkey || '-' || l_linenumber AS name, l_linestatus || (CASE WHEN l_suppkey % 5 = 0 THEN l_suppkey + 1 ELSE l_suppkey END) AS version, true AS is_declared FROM lineitem WHERE l_partkey % 13 <> 0"


@query("keyed_diff_lines", f"""
WITH o AS (SELECT artifact, manager, name, max(version) AS version FROM ({_LINES_OLD}) GROUP BY ALL), n AS (SELECT artifact, manager, name, max(version) AS version FROM ({_LINES_NEW}) GROUP BY ALL)
SELECT coalesce(o.artifact, n.artifact) AS artifact, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS kind,
  coalesce(o.manager, n.manager) AS manager, coalesce(n.name, o.name) AS name, o.version AS old_version, n.version AS new_version, true AS is_declared
FROM o FULL OUTER JOIN n ON o.artifact = n.artifact AND o.manager = n.manager AND o.name = n.name
WHERE o.name IS NULL OR n.name IS NULL OR o.version <> n.version""")
def keyed_diff_lines(spark, sf):
    """The same operator over lineitem, the largest supplied table."""
    lines = table(spark, sf, "lineitem")
    supplier = F.col("l_suppkey")

    def role(modulus, version, is_new):
        return F.when(F.col("l_partkey") % modulus != 0, F.struct(F.concat("l_linestatus", version.cast("string")).alias("version"), F.lit(is_new).alias("is_new")))

    # One scan: a line is a fact of either side, of both or of none.
    roles = F.array_compact(F.array(role(11, supplier, False), role(13, F.when(supplier % 5 == 0, supplier + 1).otherwise(supplier), True)))
    sides = lines.select(
        F.col("l_orderkey").alias("artifact"), F.col("l_returnflag").alias("manager"),
        F.concat(F.lit("p"), "l_partkey", F.lit("-"), "l_linenumber").alias("name"), F.lit(True).alias("is_declared"), F.explode(roles).alias("r"))
    return sets.keyed_diff_of(sides.select("artifact", "manager", "name", "is_declared", "r.version", "r.is_new"), ["artifact"])


@query("version_attribute_changes", """
SELECT o_custkey AS artifact, o_orderkey AS seq, a.attribute, coalesce(a.was, '?') AS was, coalesce(a.now, '?') AS now FROM (
  SELECT o_custkey, o_orderkey, unnest([{'attribute': 'runtime', 'was': CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END, 'now': CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END},
    {'attribute': 'handler', 'was': o_orderpriority, 'now': CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END}]) AS a FROM orders)
WHERE a.was IS DISTINCT FROM a.now""")
def version_attribute_changes(spark, sf):
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    keys = [F.col("o_custkey").alias("artifact"), key.alias("seq")]
    old = o.select(*keys, F.when(key % 9 != 0, F.col("o_orderstatus")).alias("runtime"), F.col("o_orderpriority").alias("handler"))
    new = o.select(*keys, F.when(key % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("runtime"),
                   F.when(key % 7 != 0, F.col("o_orderpriority")).alias("handler"))
    return sets.attribute_changes(old, new, ["artifact", "seq"], ["runtime", "handler"])


@query("apply_edits", """
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 AND c_custkey % 3 <> 0 THEN 'Renamed#' || c_custkey ELSE c_name END AS c_name,
  CASE WHEN c_custkey % 10 = 0 AND c_custkey % 3 <> 1 THEN CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE 'pinned' END ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def apply_edits(spark, sf):
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    edits = rows.where(key % 10 == 0).select(
        key, F.concat(F.lit("Renamed#"), key.cast("string")).alias("c_name"), F.when(key % 20 != 0, F.lit("pinned")).alias("c_mktsegment"),
        F.when(key % 3 == 0, F.array(F.lit("c_mktsegment"))).when(key % 3 == 1, F.array(F.lit("c_name"))).otherwise(F.array(F.lit("c_name"), F.lit("c_mktsegment"))).alias("named"))
    return sets.apply_edits(rows, edits, ["c_custkey"], ["c_name", "c_mktsegment"], named="named")


@query("cascade_delete", """
SELECT 'orders' AS relation, count(*) AS remaining FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def cascade_delete(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    doomed = orders.where(F.col("o_orderstatus") == "P").select("o_orderkey")
    kept = sets.cascade_delete({"orders": (orders, ["o_orderkey"]), "lineitem": (lines, ["l_orderkey"])}, doomed)
    counts = [df.agg(F.count(F.lit(1)).alias("remaining")).select(F.lit(name).alias("relation"), "remaining") for name, df in kept.items()]
    return counts[0].unionByName(counts[1])


@query("alias_upsert", """
SELECT artifact, pattern, first(is_regex ORDER BY o) AS is_regex FROM (
  SELECT p_brand AS artifact, p_name AS pattern, false AS is_regex, 0 AS o FROM part WHERE p_size <= 25
  UNION ALL SELECT p_brand, p_name, true, 1 FROM part) GROUP BY artifact, pattern""")
def alias_upsert(spark, sf):
    p = table(spark, sf, "part")
    existing = p.where(F.col("p_size") <= 25).select(F.col("p_brand").alias("artifact"), F.col("p_name").alias("pattern"), F.lit(False).alias("is_regex"))
    incoming = p.select(F.col("p_brand").alias("artifact"), F.col("p_name").alias("pattern"), F.lit(True).alias("is_regex"))
    return sets.upsert_ignore(existing, incoming, ["artifact", "pattern"])


@query("prefer_non_null", """
SELECT artifact, manager, k AS key, is_declared, name, version FROM (
  SELECT o_custkey % 100 AS artifact, o_orderstatus AS manager, lower(name) AS k, is_declared, name, version, o_orderkey FROM (
    SELECT *, (CASE WHEN o_orderkey % 2 = 0 THEN 'Lib' ELSE 'lib' END) || (o_orderkey % 12) AS name, o_orderkey % 4 < 2 AS is_declared,
      CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS version FROM orders))
QUALIFY row_number() OVER (PARTITION BY artifact, manager, k, is_declared ORDER BY version IS NULL, o_orderkey) = 1""")
def prefer_non_null(spark, sf):
    key = F.col("o_orderkey")
    deps = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 100).alias("artifact"), F.col("o_orderstatus").alias("manager"),
        F.concat(F.when(key % 2 == 0, "Lib").otherwise("lib"), (key % 12).cast("string")).alias("name"), (key % 4 < 2).alias("is_declared"),
        F.when(key % 3 == 0, F.col("o_orderpriority")).alias("version"), key.alias("position"))
    return sets.prefer_non_null(deps, ["artifact", "manager", F.lower("name").alias("key"), "is_declared"], "version", "position", ["name", "version"])
