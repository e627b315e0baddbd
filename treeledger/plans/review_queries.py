"""Arrivals in time, identity, search, budgets, answers and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import arrivals as arrival_ops
from ..operators import changes as change_ops
from ..operators import dependencies as dependency_ops
from ..operators import extract, facts, findings, identity, review, search, sets
from ..options import ArrivalOptions
from ..sources import adapters, manifest
from .change_queries import TOTALS_SQL, WITH_CHANGES, WITH_MOVES, changed, moves_of, totals_of
from .history_queries import _ORDERS, order_versions
from .registry import query
from .scalar_queries import _clean_sql, _slug_sql, sql_basename, sql_dirname, sql_text
from .snapshot_queries import FACTS_SQL, FILES, facts as file_facts
from .text_queries import FINDINGS_SQL, _severity_rank_sql

table, spread = adapters.table, adapters.spread_table
ARRIVALS = adapters.ARRIVALS_SQL


def user_events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")


@query("burst_dedup", "SELECT event_id, ts, user_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR epoch_us(ts) - epoch_us(b) >= 21600000000")
def burst_dedup(spark, sf):
    rows = user_events(spark, sf).drop("event_type")
    return arrival_ops.burst_dedup(rows, ["user_id"], gap_seconds=21600.0)


RUNS_SQL = """rn AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS s FROM events)),
ru AS (SELECT user_id, event_type, CAST(run AS BIGINT) AS run, count(*) AS length, min(ts) AS first_ts, max(ts) AS last_ts FROM rn GROUP BY ALL)"""


@query("runs_of_change", f"WITH {RUNS_SQL} SELECT * FROM ru")
def runs_of_change(spark, sf):
    return arrival_ops.runs(user_events(spark, sf), ["user_id"], ["event_type"])


@query("stable_signatures", f"""WITH {RUNS_SQL}, b AS (SELECT user_id, min(first_ts) AS begun FROM ru GROUP BY user_id),
f AS (SELECT * FROM ru WHERE epoch_us(last_ts) - epoch_us(first_ts) >= 36000000000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY run) = 1)
SELECT b.user_id, begun, CASE WHEN epoch_us(first_ts) - epoch_us(begun) + 36000000000 <= 864000000000 THEN first_ts END AS settled_from, CASE WHEN epoch_us(first_ts) - epoch_us(begun) + 36000000000 <= 864000000000 THEN event_type END AS event_type FROM b LEFT JOIN f ON f.user_id = b.user_id""")
def stable_signatures(spark, sf):
    """Users as paths, event types as signatures; ten hours settle, ten days give up."""
    options = ArrivalOptions(stable_seconds=36000.0, give_up_seconds=864000.0)
    return arrival_ops.stable_signatures(user_events(spark, sf), ["user_id"], ["event_type"], options)


@query("liveness_gaps", "SELECT user_id, ts AS last_beat, n AS next_ts, CAST(floor((epoch_us(n) - epoch_us(ts)) / 1000000) AS BIGINT) AS silent_seconds FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE epoch_us(n) - epoch_us(ts) > 21600000000")
def liveness_gaps(spark, sf):
    return arrival_ops.liveness_gaps(user_events(spark, sf), ["user_id"], 21600.0)


@query("activity_tumbling", "SELECT event_type, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS n FROM events GROUP BY ALL")
def activity_tumbling(spark, sf):
    return arrival_ops.activity(user_events(spark, sf), ["event_type"], "1 day")


@query("activity_sliding", "SELECT event_type, s AS window_start, s + INTERVAL 1 DAY AS window_end, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOURS, ts), time_bucket(INTERVAL 12 HOURS, ts) - INTERVAL 12 HOURS]) AS s FROM events) GROUP BY ALL")
def activity_sliding(spark, sf):
    return arrival_ops.activity(user_events(spark, sf), ["event_type"], "1 day", "12 hours")


@query("activity_session", """SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000 THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, session""")
def activity_session(spark, sf):
    return arrival_ops.sessions(user_events(spark, sf), ["user_id"], 21600.0)


@query("json_map_explode", "SELECT event_id, 'k' AS key, CAST(props::JSON->>'$.k' AS BIGINT) AS value FROM events")
def json_map_explode(spark, sf):
    parsed = table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))
    return parsed


@query("recent_events", "SELECT event_id, ts, user_id AS artifact, event_type AS kind, c_name AS name FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 30) LEFT JOIN customer ON c_custkey = user_id")
def recent_events(spark, sf):
    events = user_events(spark, sf).select("event_id", "ts", F.col("user_id").alias("artifact"), F.col("event_type").alias("kind"))
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("artifact"), F.col("c_name").alias("name"))
    return search.recent_events(events, names)


@query("search_paths", f"SELECT artifact, seq, path, size FROM ({FACTS_SQL}) WHERE path ILIKE '%D1/_5%' ORDER BY artifact, seq DESC, path LIMIT 100")
def search_paths(spark, sf):
    return search.search_paths(file_facts(spark, sf).select("artifact", "seq", "path", "size"), "D1/_5")


@query("search_facts", """SELECT DISTINCT c_name AS artifact, o_orderkey AS seq, p_brand AS manager, p_name AS name, p_type AS version FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
WHERE p_name ILIKE '%red%' ORDER BY artifact, seq DESC, manager, name, version LIMIT 200""")
def search_facts(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("manager"), F.col("p_name").alias("name"), F.col("p_type").alias("version"))
    deps = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("version_id"), "l_partkey").join(parts, "l_partkey").drop("l_partkey")
    versions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("artifact_id"), F.col("o_orderkey").alias("seq"))
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("artifact_id"), F.col("c_name").alias("artifact"))
    return search.search_facts(deps, versions, names, "red")


_ALIASES = """SELECT p_partkey AS alias_id, p_brand AS artifact, p_partkey % 4 = 1 AS is_regex,
  CASE WHEN p_partkey % 4 = 1 THEN ' #0*' || p_partkey || '[0-9]?\\.zip$' ELSE upper(p_name) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' #' || p_partkey END END AS pattern FROM part"""


def _aliases(p):
    key, regex = F.col("p_partkey"), F.col("p_partkey") % 4 == 1
    literal = F.concat(F.upper("p_name"), F.when(key % 3 == 0, "").otherwise(F.concat(F.lit(" #"), key)))
    return p.select(key.alias("alias_id"), F.col("p_brand").alias("artifact"), regex.alias("is_regex"),
                    F.when(regex, F.concat(F.lit(" #0*"), key, F.lit(r"[0-9]?\.zip$"))).otherwise(literal).alias("pattern"))


@query("alias_match", f"""WITH a AS ({_ALIASES}), n AS (SELECT p_partkey AS id, 'x ' || p_name || ' #' || (p_partkey + p_size) || '.zip' AS name FROM part),
h AS (SELECT n.id, a.alias_id, a.artifact FROM n JOIN a ON NOT is_regex AND contains(lower(n.name), lower(a.pattern))
UNION ALL SELECT n.id, a.alias_id, a.artifact FROM n JOIN a ON is_regex AND regexp_matches(n.name, a.pattern) UNION ALL SELECT id, -1, 'rule' FROM n WHERE regexp_matches(name, '#[0-9]*77\\.zip$'))
SELECT id, alias_id, artifact FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY alias_id) = 1""")
def alias_match(spark, sf):
    p, key = spread(spark, sf, "part", "p_partkey"), F.col("p_partkey")
    names = p.select(key.alias("id"), F.concat(F.lit("x "), "p_name", F.lit(" #"), (key + F.col("p_size")).cast("string"), F.lit(".zip")).alias("name"))
    return identity.alias_match(names, _aliases(p), ((-1, r"#[0-9]*77\.zip$", "rule"),))


_ASK = "CASE c_custkey % 5 WHEN 0 THEN upper(c_name) WHEN 1 THEN replace(c_name, '#', '-') WHEN 2 THEN substr(c_name, 10) WHEN 3 THEN 'omer#0000' ELSE 'nobody' || c_custkey END"


@query("resolve_names", f"""WITH k AS (SELECT c_name AS artifact, replace(c_name, '#', '-') AS slug FROM customer), q AS (SELECT c_custkey AS id, {_ASK} AS name FROM customer),
s AS (SELECT q.id, q.name, (SELECT min(artifact) FROM k WHERE lower(k.artifact) = lower(q.name)) AS n, (SELECT min(artifact) FROM k WHERE k.slug = q.name) AS g FROM q),
t AS (SELECT w.name, min(artifact) AS lo, max(artifact) AS hi FROM (SELECT DISTINCT name FROM s WHERE n IS NULL AND g IS NULL) w JOIN k ON contains(lower(k.artifact), lower(w.name)) OR contains(lower(k.slug), lower(w.name)) GROUP BY w.name)
SELECT s.id, s.name, coalesce(n, g, CASE WHEN lo = hi THEN lo END) AS artifact, CASE WHEN n IS NOT NULL THEN 'name' WHEN g IS NOT NULL THEN 'slug' WHEN lo = hi THEN 'substring' END AS how
FROM s LEFT JOIN t ON t.name = s.name AND n IS NULL AND g IS NULL""")
def resolve_names(spark, sf):
    c, key, name = spread(spark, sf, "customer", "c_custkey"), F.col("c_custkey"), F.col("c_name")
    known = c.select(name.alias("artifact"), F.replace(name, F.lit("#"), F.lit("-")).alias("slug"))
    asked = c.select(key.alias("id"), F.when(key % 5 == 0, F.upper(name)).when(key % 5 == 1, F.replace(name, F.lit("#"), F.lit("-"))).when(
        key % 5 == 2, F.substring(name, 10, 100)).when(key % 5 == 3, F.lit("omer#0000")).otherwise(F.concat(F.lit("nobody"), key)).alias("name"))
    return identity.resolve_names(asked, known)


_FILE = ("CASE o_orderkey % 8 WHEN 0 THEN 'code (' || o_orderkey || ').zip' WHEN 1 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '-final.zip' WHEN 2 THEN 'svc-' || o_orderkey || '.zip' "
         "WHEN 3 THEN 'rule_' || o_custkey || '_x.zip' WHEN 4 THEN 'download.zip' WHEN 5 THEN '12345678.zip' WHEN 6 THEN 'has-rare' || o_orderkey || '-name.zip' ELSE 'a.zip' END")
_OVERRIDE = "CASE WHEN o_orderkey % 40 = 0 THEN 'Forced ' || o_custkey END"
_SIDECAR = "CASE o_orderkey % 24 WHEN 2 THEN '{\"Configuration\": {\"FunctionName\": \"side-' || o_orderkey || '\"}}' WHEN 4 THEN '{\"FunctionName\": \"side2-' || o_orderkey || '\"}' WHEN 5 THEN 'not json' END"
_TOP = "CASE o_orderkey % 3 WHEN 0 THEN 'pkg-' || o_custkey WHEN 1 THEN 'index.js' END"
_IDENTITY_SOURCE = f"SELECT o_orderkey AS id, {_FILE} AS file_name, {_OVERRIDE} AS override, {_SIDECAR} AS sidecar, {_TOP} AS top_entry FROM orders"


def _meaningless_sql(c: str) -> str:
    words = ", ".join(sql_text(w) for w in paths.GENERIC_STEMS)
    return (f"(length({c}) < 2 OR lower({c}) IN ({words}) OR regexp_full_match({c}, '[0-9a-fA-F]{{8,}}') OR regexp_full_match({c}, '[0-9]+') "
            f"OR (length({c}) > 24 AND regexp_full_match({c}, '[A-Za-z0-9+/=_-]{{22,}}') AND NOT regexp_matches({c}, '[-_]')))")


@query("identify_names", f"""WITH s AS (SELECT *, regexp_replace(file_name, '\\.zip$', '') AS stem FROM ({_IDENTITY_SOURCE})),
c AS ({_clean_sql('SELECT id, stem AS raw FROM s')}),
pa AS (SELECT p_partkey AS alias_id, 'Brand#' || p_partkey AS artifact, p_partkey % 2 = 0 AS is_regex, CASE WHEN p_partkey % 2 = 0 THEN '^has-rare' || p_partkey || '-' ELSE 'rare' || p_partkey || '-' END AS pattern FROM part),
al AS (SELECT s.id, arg_min(artifact, alias_id) AS artifact FROM s JOIN pa ON contains(s.file_name, '-rare') AND CASE WHEN is_regex THEN regexp_matches(s.file_name, pattern) ELSE contains(lower(s.file_name), pattern) END GROUP BY s.id), k AS (SELECT lower(c_name) AS k, min(c_name) AS known FROM customer GROUP BY 1),
j AS (SELECT s.*, c.s AS clean, k1.known AS k1, k2.known AS k2, al.artifact AS al,
  CASE WHEN regexp_matches(file_name, 'rule_([0-9]+)') THEN 'ruled-' || regexp_extract(file_name, 'rule_([0-9]+)', 1) END AS ru,
  coalesce(CASE WHEN json_valid(sidecar) THEN sidecar->>'$.Configuration.FunctionName' END, CASE WHEN json_valid(sidecar) THEN sidecar->>'$.FunctionName' END) AS si
  FROM s JOIN c ON c.id = s.id LEFT JOIN al ON al.id = s.id LEFT JOIN k k1 ON k1.k = lower(c.s) LEFT JOIN k k2 ON k2.k = lower(s.stem)),
d AS (SELECT *, coalesce(nullif(clean, ''), nullif(stem, ''), 'unknown') AS last FROM j),
r AS (SELECT id, file_name, coalesce(override, al, ru, si, k1, k2, CASE WHEN clean <> '' AND NOT {_meaningless_sql('clean')} THEN clean END,
    CASE WHEN NOT regexp_matches(top_entry, '\\.(py|js|json|mjs|cjs)$') AND NOT {_meaningless_sql('top_entry')} THEN top_entry END, CASE WHEN {_meaningless_sql('last')} THEN 'unknown-' || substr({_slug_sql('stem')}, 1, 8) ELSE last END) AS name,
  CASE WHEN override IS NOT NULL THEN 'explicit' WHEN al IS NOT NULL THEN 'alias' WHEN ru IS NOT NULL THEN 'config-rule' WHEN si IS NOT NULL THEN 'sidecar-json' WHEN coalesce(k1, k2) IS NOT NULL THEN 'known-function'
    WHEN clean <> '' AND NOT {_meaningless_sql('clean')} THEN 'filename' WHEN NOT regexp_matches(top_entry, '\\.(py|js|json|mjs|cjs)$') AND NOT {_meaningless_sql('top_entry')} THEN 'zip-top-level' ELSE 'fallback' END AS strategy FROM d)
SELECT *, CASE WHEN strategy IN ('explicit', 'alias', 'config-rule', 'sidecar-json', 'known-function') THEN 'high' WHEN strategy = 'filename' THEN 'medium' ELSE 'low' END AS confidence, {_slug_sql('name')} AS slug FROM r""")
def identify_names(spark, sf):
    arrivals = spread(spark, sf, "orders", "o_orderkey").select(
        F.col("o_orderkey").alias("id"), F.expr(_FILE.replace("CAST(o_custkey AS VARCHAR)", "CAST(o_custkey AS STRING)")).alias("file_name"),
        F.expr(_OVERRIDE).alias("override"), F.expr(_SIDECAR).alias("sidecar"), F.expr(_TOP).alias("top_entry"))
    known = table(spark, sf, "customer").select(F.col("c_name").alias("artifact"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("slug"))
    part, regex = F.col("p_partkey"), F.col("p_partkey") % 2 == 0
    aliases = table(spark, sf, "part").select(
        part.alias("alias_id"), F.concat(F.lit("Brand#"), part).alias("artifact"), regex.alias("is_regex"),
        F.concat(F.when(regex, "^has-rare").otherwise("rare"), part, F.lit("-")).alias("pattern"))
    return identity.identify(arrivals, known, aliases, (("rule_([0-9]+)", "ruled-$1"),))


@query("manifest_roundtrip", FACTS_SQL)
def manifest_roundtrip(spark, sf):
    """Facts written as nested documents and read back flat."""
    documents = manifest.to_manifests(file_facts(spark, sf), part_files=25)
    return manifest.manifest_files(manifest.parse_manifests(documents))


_CITED = "CASE doc_id % 6 WHEN 0 THEN '`b/' || path || ':12`' WHEN 1 THEN name WHEN 2 THEN './' || path WHEN 3 THEN '/new/' || path WHEN 4 THEN 'd' || (doc_id % 4) || '/' || name ELSE '\"' || substr(path, 2) || '\"' END"
_KNOWN_SQL = f"SELECT DISTINCT artifact, path FROM ({FILES})"


@query("resolve_citations", f"""WITH k AS ({_KNOWN_SQL}), c AS (SELECT DISTINCT artifact, {_CITED} AS cited FROM (SELECT *, {sql_basename('path')} AS name FROM ({FILES}))),
r AS (SELECT *, trim(regexp_replace(trim(cited), '^[`''"]+|[`''"]+$', '', 'g')) AS raw FROM c),
s1 AS (SELECT *, regexp_replace(raw, '^/old/', '') AS a FROM r), s2 AS (SELECT *, regexp_replace(a, '^/new/', '') AS b FROM s1), s3 AS (SELECT *, regexp_replace(b, '^a/', '') AS d FROM s2),
s4 AS (SELECT *, regexp_replace(regexp_replace(d, '^b/', ''), '^\\./', '') AS e FROM s3), s5 AS (SELECT *, trim(string_split(e, ':')[1]) AS clean FROM s4)
SELECT s5.artifact, s5.cited, coalesce(k1.path, k2.path, (SELECT CASE WHEN count(*) = 1 THEN min(k.path) END FROM k WHERE k.artifact = s5.artifact AND ends_with(k.path, '/' || s5.clean))) AS path
FROM s5 LEFT JOIN k k1 ON k1.artifact = s5.artifact AND k1.path = s5.raw LEFT JOIN k k2 ON k2.artifact = s5.artifact AND k2.path = s5.clean""")
def resolve_citations(spark, sf):
    files = adapters.snapshot_files(spark, sf).select("artifact", "path", "doc_id").withColumn("name", paths.basename(F.col("path")))
    cited = files.select("artifact", F.expr(_CITED).alias("cited")).distinct()
    return review.resolve_citations(cited, files.select("artifact", "path"), ["artifact"])


@query("json_from_text", """SELECT event_id, event_id % 5 <> 4 AS structured, CASE WHEN event_id % 5 = 4 THEN 'No object here.' ELSE 'event ' || event_type END AS headline,
  CASE WHEN event_id % 5 = 4 THEN 'No object here. Only ' || event_type || '.' ELSE 'k is ' || (props::JSON->>'$.k') END AS summary, CASE WHEN event_id % 5 = 4 THEN '' WHEN event_id % 3 = 0 THEN 'high' ELSE '' END AS risk FROM events""")
def json_from_text(spark, sf):
    """Properties wrapped in prose, fences and stray braces, read back as answers."""
    key, k = F.col("event_id"), F.get_json_object("props", "$.k")
    body = F.to_json(F.struct(F.concat(F.lit("event  "), "event_type").alias("headline"), F.concat(F.lit(" k is\n"), k).alias("summary"),
                              F.when(key % 3 == 0, "HIGH").otherwise("dire").alias("risk")))
    text = (F.when(key % 5 == 0, body).when(key % 5 == 1, F.concat(F.lit("Sure!\n```json\n"), body, F.lit("\n```\nBye {x}")))
            .when(key % 5 == 2, F.concat(F.lit("Here: "), body, F.lit(" done."))).when(key % 5 == 3, F.concat(F.lit("With {a brace first: "), body))
            .otherwise(F.concat(F.lit("No object here. Only "), "event_type", F.lit("."))))
    answers = spread(spark, sf, "events", "event_id").select("event_id", text.alias("text"))
    return review.parse_answers(answers, "event_id").select("event_id", "structured", "headline", "summary", "risk")


_PRIORITY_SQL = "CASE kind WHEN 'modified' THEN 1 WHEN 'renamed' THEN 2 WHEN 'added' THEN 3 WHEN 'mode-changed' THEN 4 ELSE 5 END"


@query("budget_pack", f"""WITH d AS (SELECT source AS artifact, doc_id, lang, n_chars FROM documents),
s AS (SELECT *, CAST(least(n_chars, 3000) AS BIGINT) AS charged FROM d)
SELECT artifact, doc_id, charged, CAST(sum(charged) OVER w AS BIGINT) AS used, row_number() OVER w AS position, sum(charged) OVER w <= 9000 AS included FROM s WINDOW w AS (PARTITION BY artifact ORDER BY CASE lang WHEN 'en' THEN 0 ELSE 1 END, doc_id ROWS UNBOUNDED PRECEDING)""")
def budget_pack(spark, sf):
    """English documents first, under a budget per source."""
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("artifact"), "doc_id", "n_chars", F.when(F.col("lang") == "en", 0).otherwise(1).cast("bigint").alias("band"))
    packed = review.prefix_pack(docs, ["artifact"], [F.col("band"), F.col("doc_id")], F.col("n_chars"), 9000)
    return packed.select("artifact", "doc_id", "charged", "used", "position", "included")


FOLD_SQL = """WITH RECURSIVE i AS ({items}), n AS (SELECT *, row_number() OVER (PARTITION BY artifact ORDER BY {order}) AS pl FROM i),
f AS (SELECT artifact, 0 AS pl, {start}::BIGINT AS used FROM (SELECT DISTINCT artifact FROM i) UNION ALL SELECT n.artifact, n.pl, {step} FROM f JOIN n ON n.artifact = f.artifact AND n.pl = f.pl + 1)"""


@query("budget_fold", FOLD_SQL.format(
    items="SELECT source AS artifact, doc_id, length(source || doc_id) AS t, n_chars AS b, lang FROM documents", order="lang <> 'en', doc_id", start="500",
    step="CASE WHEN least(3000, 9000 - used - t - 40) >= 400 THEN used + t + 1 + least(b, least(3000, 9000 - used - t - 40)) + 2 ELSE used END") + """
SELECT n.artifact, n.doc_id, least(3000, 9000 - p.used - t - 40) >= 400 AS included, CAST(CASE WHEN least(3000, 9000 - p.used - t - 40) >= 400 THEN least(b, least(3000, 9000 - p.used - t - 40)) ELSE 0 END AS BIGINT) AS quoted_chars FROM n JOIN f p ON p.artifact = n.artifact AND p.pl = n.pl - 1""")
def budget_fold(spark, sf):
    """The skipping rule: an item without room is passed over, later ones may fit."""
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("artifact"), "doc_id", F.when(F.col("lang") == "en", 0).otherwise(1).cast("bigint").alias("band"),
        F.length(F.concat("source", F.col("doc_id").cast("string"))).cast("bigint").alias("title_chars"), F.col("n_chars").alias("body_chars"), F.lit(500).alias("head_chars"))
    packed = review.pack_sections(docs, ["artifact"], [F.col("band"), F.col("doc_id")], "head_chars", 9000)
    return packed.select("artifact", "doc_id", "included", "quoted_chars")


@query("tiered_budget", FOLD_SQL.format(
    items=f"""SELECT f.artifact, f.seq = 2 AS is_new, f.path, f.size, CASE WHEN f.path IN (SELECT path FROM c WHERE c.artifact = f.artifact AND c.seq = f.seq) THEN 0 WHEN {sql_dirname('f.path')} IN (SELECT {sql_dirname('path')} FROM c WHERE c.artifact = f.artifact) THEN 1 ELSE 2 END AS tier
      FROM f0 f WHERE f.size <= 8000""", order="tier, path, is_new DESC", start="0", step="CASE WHEN used + size <= 60000 THEN used + size ELSE used END").replace(
    "WITH RECURSIVE", f"WITH RECURSIVE f0 AS ({FACTS_SQL}), c AS (SELECT artifact, seq, path FROM f0 WHERE ends_with(path, '5.txt')),") + """
SELECT n.artifact, n.is_new, n.path, n.size, n.tier, p.used + n.size <= 60000 AS included, CASE WHEN p.used + n.size > 60000 THEN 'past the size limit' END AS reason FROM n JOIN f p ON p.artifact = n.artifact AND p.pl = n.pl - 1
UNION ALL SELECT f.artifact, f.seq = 2, f.path, f.size, CASE WHEN f.path IN (SELECT path FROM c WHERE c.artifact = f.artifact AND c.seq = f.seq) THEN 0 WHEN """ + sql_dirname("f.path") + """ IN (SELECT """ + sql_dirname("path") + """ FROM c WHERE c.artifact = f.artifact) THEN 1 ELSE 2 END, false, 'too large to read' FROM f0 f WHERE f.size > 8000""")
def tiered_budget(spark, sf):
    files = file_facts(spark, sf).select("artifact", (F.col("seq") == 2).alias("is_new"), "path", "size", "is_text")
    chosen = files.where(F.col("path").endswith("5.txt")).select("artifact", "is_new", "path")
    return review.tiered_budget(files, chosen, ["artifact"], 60000, 8000).select("artifact", "is_new", "path", "size", "tier", "included", "reason")


@query("manifest_dependencies", adapters.MANIFEST_FACTS_SQL)
def manifest_dependencies(spark, sf):
    """Dependencies read from manifests of ten kinds."""
    return dependency_ops.dependencies(adapters.manifest_files(spark, sf)).select("artifact", "seq", "manager", "name", "version", "source", "is_declared")


@query("version_summary", f"""SELECT artifact, seq, file_count, total_size, code_file_count, code_lines, coalesce(declared, 0) AS declared, coalesce(installed, 0) AS installed, env_names, services, coalesce(findings, 0) AS findings
FROM (SELECT artifact, count(*) FILTER (is_declared) AS declared, count(*) FILTER (NOT is_declared) AS installed FROM ({adapters.MANIFEST_FACTS_SQL}) GROUP BY artifact)
FULL JOIN (SELECT artifact, count(*) AS findings FROM ({adapters.MANIFEST_FILES_SQL}) WHERE regexp_matches(content, 'AKIA[0-9A-Z]{{16}}') GROUP BY 1) USING (artifact) RIGHT JOIN (
  WITH f AS (SELECT artifact, seq, path, content, regexp_full_match(path, 'node_modules/.*') OR contains(path, '.dist-info/') AS v FROM (SELECT * FROM ({adapters.CODE_FILES_SQL}) UNION ALL ({adapters.MANIFEST_FILES_SQL})))
  SELECT artifact, seq, count(*) AS file_count, CAST(sum(strlen(content)) AS BIGINT) AS total_size, count(*) FILTER (NOT v) AS code_file_count,
    CAST(coalesce(sum(length(content) - length(replace(content, chr(10), ''))) FILTER (NOT v), 0) AS BIGINT) AS code_lines,
    count(DISTINCT CASE WHEN NOT v THEN nullif(coalesce(nullif(regexp_extract(content, 'NAME = os\\.environ\\["(\\w+)"', 1), ''), nullif(regexp_extract(content, 'process\\.env\\.(\\w+)', 1), ''), nullif(regexp_extract(content, 'process\\.env\\[''(\\w+)', 1), ''), nullif(regexp_extract(content, 'System\\.getenv\\("(\\w+)', 1), ''), nullif(regexp_extract(content, 'os\\.environ\\.get\\("(\\w+)', 1), '')), '') END) AS env_names,
    count(DISTINCT CASE WHEN NOT v THEN CASE WHEN contains(content, 'dynamodb') THEN 'dynamodb' WHEN contains(content, 'client-sfn') THEN 'stepfunctions' WHEN contains(content, 'AWS.S3') THEN 's3' WHEN contains(content, 'services.sqs') THEN 'sqs' END END) AS services
  FROM f GROUP BY artifact, seq) USING (artifact)""")
def version_summary(spark, sf):
    files = adapters.code_files(spark, sf).unionByName(adapters.manifest_files(spark, sf))
    totals = facts.version_totals(facts.file_facts(files)).select("artifact", "seq", "file_count", "total_size", "code_file_count", "code_lines")
    return search.version_summary(totals, dependency_ops.dependencies(files), extract.extract_refs(files), findings.findings(files), ["artifact", "seq"])


@query("comparison_brief", f"""{WITH_MOVES}, {TOTALS_SQL},
o AS (SELECT artifact, '# ' || artifact || ': version 1 to version 2' || chr(10) || '- files changed: ' || added || ' added, ' || removed || ' removed, ' || modified || ' modified, ' || renamed || ' renamed; +' || added_lines || ' -' || removed_lines || ' lines' || chr(10) || '- vendored files changed: ' || vendored_hidden AS t FROM tt),
m AS (SELECT artifact, string_agg('- ' || old_dir || '/ → ' || new_dir || '/ (' || moved || ' files)', chr(10) ORDER BY old_dir, new_dir) || CASE WHEN max(n) > 100 THEN chr(10) || '- … and ' || (max(n) - 100) || ' more' ELSE '' END AS b FROM (SELECT *, count(*) OVER (PARTITION BY artifact) AS n FROM mo WHERE NOT is_vendor QUALIFY row_number() OVER (PARTITION BY artifact ORDER BY old_dir, new_dir) <= 100) GROUP BY artifact),
e AS (SELECT artifact, string_agg('- ' || kind || ': ' || path || ' (+' || added_lines || ' -' || removed_lines || ')', chr(10) ORDER BY p) || CASE WHEN max(n) > 5 THEN chr(10) || '- … and ' || (max(n) - 5) || ' more' ELSE '' END AS b FROM (SELECT *, count(*) OVER (PARTITION BY artifact) AS n, row_number() OVER (PARTITION BY artifact ORDER BY {_PRIORITY_SQL}, added_lines + removed_lines DESC, path) AS p FROM fc WHERE NOT is_vendor) WHERE p <= 5 GROUP BY artifact),
{FINDINGS_SQL}, fo AS (SELECT * FROM fv WHERE seq = 1), fq AS (SELECT * FROM fv WHERE seq = 2 AND NOT is_vendor AND NOT EXISTS (SELECT 1 FROM fo WHERE fo.artifact = fv.artifact AND fo.kind = fv.kind AND fo.path = fv.path AND fo.detail = fv.detail)),
s3 AS (SELECT artifact, string_agg('- NEW ' || severity || ' ' || kind || ' at ' || path || ':' || line_no || ' (' || detail || ')', chr(10) ORDER BY p) || CASE WHEN max(n) > 30 THEN chr(10) || '- … and ' || (max(n) - 30) || ' more' ELSE '' END AS b
  FROM (SELECT *, count(*) OVER (PARTITION BY artifact) AS n, row_number() OVER (PARTITION BY artifact ORDER BY {_severity_rank_sql('severity')}, path, line_no, detail) AS p FROM fq) WHERE p <= 30 GROUP BY artifact)
SELECT o.artifact, t || coalesce(chr(10) || chr(10) || '## Directory moves' || chr(10) || m.b, '') || coalesce(chr(10) || chr(10) || '## Largest changes' || chr(10) || e.b, '') || coalesce(chr(10) || chr(10) || '## Security scanner' || chr(10) || s3.b, '') AS brief
FROM o LEFT JOIN m ON m.artifact = o.artifact LEFT JOIN e ON e.artifact = o.artifact LEFT JOIN s3 ON s3.artifact = o.artifact""")
def comparison_brief(spark, sf):
    changes = change_ops.durable(changed(spark, sf))
    t = totals_of(spark, sf, changes)
    text = F.concat(
        F.lit("# "), "artifact", F.lit(": version 1 to version 2\n- files changed: "), F.col("added").cast("string"), F.lit(" added, "), F.col("removed").cast("string"),
        F.lit(" removed, "), F.col("modified").cast("string"), F.lit(" modified, "), F.col("renamed").cast("string"), F.lit(" renamed; +"), F.col("added_lines").cast("string"),
        F.lit(" -"), F.col("removed_lines").cast("string"), F.lit(" lines\n- vendored files changed: "), F.col("vendored_hidden").cast("string"))
    moved = F.concat(F.lit("- "), "old_dir", F.lit("/ → "), "new_dir", F.lit("/ ("), F.col("moved").cast("string"), F.lit(" files)"))
    moves = review.section(moves_of(spark, sf, changes).where(~F.col("is_vendor")), ["artifact"], [F.col("old_dir"), F.col("new_dir")], moved, 1, "Directory moves", 100)
    lines = F.col("added_lines") + F.col("removed_lines")
    order = [F.array_position(F.array(*[F.lit(k) for k in review.REVIEW_KINDS]), F.col("kind")), lines.desc(), F.col("path")]
    edited = F.concat(F.lit("- "), "kind", F.lit(": "), "path", F.lit(" (+"), F.col("added_lines").cast("string"), F.lit(" -"), F.col("removed_lines").cast("string"), F.lit(")"))
    edits = review.section(changes.where(~F.col("is_vendor")), ["artifact"], order, edited, 2, "Largest changes", 5)
    rows = findings.findings(adapters.snapshot_files(spark, sf)).where(~F.col("is_vendor")).select("artifact", "seq", "path", "kind", "severity", "line_no", "detail")
    sides = [rows.where(F.col("seq") == n).drop("seq") for n in (1, 2)]
    fresh = sets.findings_delta(*sides, ["artifact", "kind", "path", "detail"]).where(F.col("status") == "new")
    order = [findings.severity_rank(F.col("severity")), F.col("path"), F.col("line_no"), F.col("detail")]
    scanned = review.section(fresh, ["artifact"], order, review.finding_line(), 3, "Security scanner", 30)
    return review.brief(t.select("artifact", text.alias("text")), moves.unionByName(edits).unionByName(scanned), ["artifact"])
