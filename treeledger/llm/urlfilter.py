"""URL filters: longest matching rule first, else trust and distrust spread over the host link graph.

Hosts whose pages rules allow or block are seeds, weighted by the share of their ruled
pages. Trust is personalised PageRank along links from the trusted seeds; distrust runs
against the links from the blocked seeds, so a host that links to bad hosts inherits it.
A host is blocked where distrust exceeds ``ratio`` times its trust.

DataFrame functions only. Links are reduced to host pairs inside the scan, so a host with a
third of all pages is one row per target and task; link targets without pages take part.
A url that is null or has no ``://`` has empty host and path and is judged allow; null html
has no links; repeated pages count as often as they occur; an empty table gives no rows;
extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.registry import query
from treeledger.operators.durable import durable, fetch
from treeledger.sources.adapters import table

# The rules as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'<>\s]+)"""


@dataclass(frozen=True)
class Propagation:
    damping: float = 0.85
    rounds: int = 12
    ratio: float = 3.0
    least: float = 1e-9


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits ``host`` and ``path``; null without one."""
    best = F.lit(None)
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        best = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, links: pages of one host that link to another."""
    linked = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER)))
    return (
        pages.select(F.col("host").alias("src"), F.explode(linked).alias("dst"))
        .where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))
    )


def spread(seeds: DataFrame, edges: DataFrame, options: Propagation = Propagation()) -> DataFrame:
    """host, trust, distrust after the given rounds. ``seeds``: host, trust, distrust weights."""
    def along(kind, a, b):
        out = edges.groupBy(a).agg(F.sum("links").alias("all_"))
        return edges.join(out, a).select(F.lit(kind).alias("kind"), F.col(a).alias("giver"), F.col(b).alias("taker"), (F.col("links") / F.col("all_")).alias("part"))

    steps = durable(along("trust", "src", "dst").unionByName(along("distrust", "dst", "src")))
    start = durable(seeds.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, weight)")).where("weight > 0"))
    d = options.damping
    restart = start.select("kind", "host", (F.col("weight") * (1 - d)).alias("score"))
    state = restart
    for k in range(options.rounds):
        moved = steps.join(state.withColumnRenamed("host", "giver"), ["kind", "giver"]).select("kind", F.col("taker").alias("host"), (F.col("score") * F.col("part") * d).alias("score"))
        state = moved.unionByName(restart).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % 4 == 3:
            state = durable(state)
    pick = {kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind) for kind in ("trust", "distrust")}
    return state.groupBy("host").agg(*pick.values())


def judged(pages: DataFrame, rules=RULES, options: Propagation = Propagation()) -> DataFrame:
    """page_id, url, host, path, rule, verdict, trust, distrust for every page."""
    host, path = host_and_path(F.col("url"))
    known = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path")).withColumn("match_", matched_rule(rules))
    ruled = known.where("match_ is not null and host <> ''").groupBy("host").agg(
        F.count(F.when(F.col("match_.verdict") == "allow", 1)).alias("a"), F.count(F.lit(1)).alias("n"))
    seeds = ruled.select("host", (F.col("a") / F.col("n")).alias("trust"), ((F.col("n") - F.col("a")) / F.col("n")).alias("distrust"))
    scores = durable(spread(seeds, host_edges(known), options))
    own = F.when(F.coalesce("distrust", F.lit(0.0)) > options.ratio * F.coalesce("trust", F.lit(0.0)) + options.least, "block").otherwise("allow")
    return fetch(known.drop("html"), scores, ["host"], "left").select(
        "page_id", "url", "host", "path", "match_.rule", F.coalesce("match_.verdict", own).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def judged_sql(rules=RULES, options: Propagation = Propagation()) -> str:
    def pick(value):
        cases = "".join(
            f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {value(v, h + p)}"
            for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])))
        return f"CASE{cases} END"

    link, d = LINK.replace("'", "''"), options.damping
    rounds = ""
    for k in range(options.rounds):
        rounds += f"""
state{k + 1} AS MATERIALIZED (
  SELECT kind, host, sum(score) AS score FROM (
    SELECT s.kind, t.taker AS host, s.score * t.part * {d} AS score FROM steps t JOIN state{k} s ON s.kind = t.kind AND s.host = t.giver
    UNION ALL SELECT * FROM state0) GROUP BY 1, 2),"""
    return f"""
WITH rests AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
known AS MATERIALIZED (SELECT *, {pick(lambda v, r: f"'{r}'")} AS rule, {pick(lambda v, r: f"'{v}'")} AS ruled FROM parts),
seeds AS (
  SELECT host, count(*) FILTER (WHERE ruled = 'allow') / count(*)::DOUBLE AS trust, count(*) FILTER (WHERE ruled = 'block') / count(*)::DOUBLE AS distrust
  FROM known WHERE ruled IS NOT NULL AND host <> '' GROUP BY host),
edges AS MATERIALIZED (
  SELECT src, dst, count(*) AS links FROM (
    SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda h: translate(h, '{UPPER}', '{LOWER}')))) AS dst FROM known)
  WHERE src <> '' AND src <> dst GROUP BY 1, 2),
steps AS MATERIALIZED (
  SELECT 'trust' AS kind, src AS giver, dst AS taker, links / (sum(links) OVER (PARTITION BY src))::DOUBLE AS part FROM edges
  UNION ALL SELECT 'distrust', dst, src, links / (sum(links) OVER (PARTITION BY dst))::DOUBLE FROM edges),
state0 AS MATERIALIZED (
  SELECT kind, host, weight * {1 - d} AS score FROM (
    SELECT 'trust' AS kind, host, trust AS weight FROM seeds UNION ALL SELECT 'distrust', host, distrust FROM seeds) WHERE weight > 0),{rounds}
scores AS (
  SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) AS distrust
  FROM state{options.rounds} GROUP BY host)
SELECT k.page_id, k.host, k.path, k.rule, coalesce(k.ruled, CASE WHEN coalesce(s.distrust, 0) > {options.ratio} * coalesce(s.trust, 0) + {options.least}
  THEN 'block' ELSE 'allow' END) AS verdict, coalesce(s.trust, 0)::DOUBLE AS trust, coalesce(s.distrust, 0)::DOUBLE AS distrust
FROM known k LEFT JOIN scores s ON s.host = k.host
"""


@query("op4_link_trust", judged_sql())
def op4_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).drop("url")
