"""Extraction, findings, redaction and content differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract, facts, findings, lines, sets, similar
from ..operators import dependencies as dependency_ops
from ..operators.alignment import sql_script
from ..sources import adapters
from .change_queries import LINES_SQL, PAIR_LINES_SQL, modified_sides
from .registry import query
from .scalar_queries import sql_basename, sql_dirname, sql_extension, sql_language, sql_line_count, sql_lines, sql_shared_prefix, sql_text, sql_vendored, sql_whitespace_key

table, spread = adapters.table, adapters.spread_table
FILES, CODE, TURNS = adapters.SNAPSHOT_FILES_SQL, adapters.CODE_FILES_SQL, adapters.TURNS_SQL


def sql_numbered(source: str, keys: str) -> str:
    return f"SELECT {keys}, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT {keys}, {sql_lines('content')} AS l FROM ({source}))"


def sql_found(patterns, group: int = 1, column: str = "line") -> str:
    out = f"regexp_extract_all({column}, {sql_text(patterns[0])}, {group})"
    for p in patterns[1:]:
        out = f"list_concat({out}, regexp_extract_all({column}, {sql_text(p)}, {group}))"
    return out


def _langs(names) -> str:
    return ", ".join(sql_text(n) for n in names)


_ALIASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in extract.SERVICE_ALIASES.items())
REFS_SQL = f"""
cl AS ({sql_numbered(f"SELECT artifact, seq, path, content, {sql_language('path')} AS lang FROM ({CODE}) WHERE NOT {sql_vendored('path')}", 'artifact, seq, path, lang')}),
rf AS (SELECT DISTINCT artifact, seq, path, line_no, 'env' AS kind, unnest({sql_found(extract.ENV_PATTERNS)}) AS name FROM cl WHERE lang IN ({_langs(extract.ENV_LANGUAGES)})
  UNION SELECT DISTINCT artifact, seq, path, line_no, 'service', CASE lower(name) {_ALIASES} ELSE lower(name) END FROM (
    SELECT *, unnest({sql_found(extract.SERVICE_PATTERNS)}) AS name FROM cl WHERE lang IN ({_langs(extract.SERVICE_LANGUAGES)}))),
rr AS (SELECT artifact, seq, path, kind, name, CAST(line_no AS INTEGER) AS line_no, kind = 'env' AND name IN ({_langs(extract.RESERVED_ENV)}) AS is_reserved FROM rf)"""


def refs(spark, sf):
    return extract.extract_refs(adapters.code_files(spark, sf))


@query("code_refs", f"WITH {REFS_SQL} SELECT * FROM rr")
def code_refs(spark, sf):
    return refs(spark, sf)


@query("extract_refs_first", f"WITH {REFS_SQL} SELECT artifact, seq, kind, name, path, min(line_no) AS line_no FROM rr GROUP BY ALL")
def extract_refs_first(spark, sf):
    return extract.first_per_file(refs(spark, sf))


@query("distinct_refs", f"WITH {REFS_SQL} SELECT DISTINCT artifact, seq, kind, name FROM rr WHERE NOT is_reserved")
def distinct_refs(spark, sf):
    return extract.distinct_refs(refs(spark, sf))


@query("refs_delta", f"""WITH {REFS_SQL}, o AS (SELECT DISTINCT artifact, kind, name FROM rr WHERE NOT is_reserved AND length(path) % 3 <> 0), n AS (SELECT DISTINCT artifact, kind, name FROM rr WHERE NOT is_reserved AND length(path) % 4 <> 0)
SELECT *, 'added' AS status FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def refs_delta(spark, sf):
    """Names read by one version of the code and not by the other."""
    found = refs(spark, sf).where(~F.col("is_reserved"))
    sides = [found.where(F.length("path") % m != 0).select("artifact", "kind", "name") for m in (3, 4)]
    return sets.name_delta(sides[0], sides[1], ["artifact", "kind", "name"])


_HREF, _NUMBER = r'href="([^"]+)"', r"\b([0-9]{3,})\b"
LINKS = (extract.Catalogue("link", (_HREF,), hints=("href=",)), extract.Catalogue("number", (_NUMBER,)))


@query("extract_refs", f"""
WITH p AS (SELECT page_id, url AS path, html AS content FROM pages), l AS ({sql_numbered('SELECT * FROM p', 'page_id, path')})
SELECT DISTINCT page_id, path, kind, name, CAST(line_no AS INTEGER) AS line_no, false AS is_reserved FROM (
  SELECT page_id, path, line_no, 'link' AS kind, unnest(regexp_extract_all(line, {sql_text(_HREF)}, 1)) AS name FROM l
  UNION ALL SELECT page_id, path, line_no, 'number', unnest(regexp_extract_all(line, {sql_text(_NUMBER)}, 1)) FROM l)""")
def extract_refs(spark, sf):
    """The reference extractor with another catalogue: links and numbers of pages."""
    pages = spread(spark, sf, "pages", "page_id").select("page_id", F.col("url").alias("path"), F.col("html").alias("content"))
    return extract.extract_refs(pages, LINKS, include_vendored=True, keys=("page_id", "path"))


_PREFERRED = " ".join(f"WHEN '{n}' THEN {50 - i}" for i, n in enumerate(extract.PREFERRED_FILES))


@query("handler_candidates", f"""
WITH f AS (SELECT artifact, seq, path, content, {sql_language('path')} AS lang, CASE {sql_basename('path')} {_PREFERRED} ELSE 0 END + CASE WHEN path NOT LIKE '%/%' THEN 20 ELSE 0 END AS base FROM ({CODE}) WHERE NOT {sql_vendored('path')}),
s AS (SELECT *, CASE WHEN lang = 'python' THEN regexp_extract_all(content, {sql_text(extract.PYTHON_ENTRY)}, 1)
    WHEN lang IN ('javascript', 'typescript') THEN list_transform(regexp_extract_all(content, {sql_text(extract.SCRIPT_ENTRY)}, 0), lambda m: regexp_extract(m, {sql_text(extract.SCRIPT_ENTRY)}, 1) || regexp_extract(m, {sql_text(extract.SCRIPT_ENTRY)}, 2))
    WHEN lang = 'java' AND regexp_matches(content, {sql_text(extract.JAVA_ENTRY)}) THEN ['handleRequest'] ELSE [] END AS symbols FROM f WHERE lang IN ('python', 'javascript', 'typescript', 'java')),
e AS (SELECT artifact, seq, path, lang, base, unnest(symbols) AS symbol, unnest(range(len(symbols))) AS pos FROM s),
c AS (SELECT artifact, seq, path, symbol, pos, replace(regexp_replace(path, '\\.[^./]+$', ''), '/', '.') || CASE WHEN lang = 'java' THEN '' ELSE '.' || symbol END AS handler,
  base + CASE WHEN lang = 'java' THEN 20 ELSE CASE WHEN (lang = 'python' AND symbol IN ('lambda_handler', 'handler')) OR (lang <> 'python' AND symbol = 'handler') THEN 30 ELSE 0 END - CASE WHEN lang = 'python' AND starts_with(symbol, '_') THEN 15 ELSE 0 END END AS score FROM e),
u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY artifact, seq, handler ORDER BY score DESC, length(path) - length(replace(path, '/', '')), length(path), path, pos) = 1)
SELECT artifact, seq, row_number() OVER (PARTITION BY artifact, seq ORDER BY score DESC, length(path) - length(replace(path, '/', '')), length(path), path, pos) AS rank, path, symbol, handler, CAST(score AS BIGINT) AS score
FROM u""")
def handler_candidates(spark, sf):
    return extract.entry_points(adapters.code_files(spark, sf))


def _points_sql(mapping, key: str, what: int) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {sql_text(v[0]) if what == 0 else v[1]}" for k, v in mapping.items()) + " END"


@query("score_classes", f"""
WITH f AS (SELECT artifact, seq, path, lower({sql_basename('path')}) AS name, {sql_extension('path')} AS ext, {sql_vendored('path')} AS v, length(path) - length(replace(path, '/', '')) AS depth FROM ({CODE})),
h AS (SELECT artifact, seq, path, {_points_sql(extract.MARKER_FILES, 'name', 0)} AS class, CASE WHEN v THEN greatest(1, p // 10) WHEN depth > 1 THEN greatest(2, p // 3) ELSE p END AS points, path AS why, 0 AS step
    FROM (SELECT *, {_points_sql(extract.MARKER_FILES, 'name', 1)} AS p FROM f) WHERE p IS NOT NULL
  UNION ALL SELECT artifact, seq, path, {_points_sql(extract.EXTENSION_POINTS, 'ext', 0)}, {_points_sql(extract.EXTENSION_POINTS, 'ext', 1)}, '*' || ext, 1 FROM f WHERE NOT v AND {_points_sql(extract.EXTENSION_POINTS, 'ext', 0)} IS NOT NULL
  UNION ALL SELECT artifact, seq, path, 'dotnet', 25, path, 2 FROM f WHERE ends_with(path, '.runtimeconfig.json') OR ends_with(path, '.deps.json')),
c AS (SELECT artifact, seq, class, sum(points) AS score, min((step = 2, path, step)) AS seen FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY artifact, seq ORDER BY score DESC, seen) AS rn, coalesce(lead(score) OVER (PARTITION BY artifact, seq ORDER BY score DESC, seen), 0) AS second FROM c),
w AS (SELECT artifact, seq, why, min((step = 2, path, step)) AS seen FROM h GROUP BY artifact, seq, why),
e AS (SELECT artifact, seq, string_agg(why, ' ' ORDER BY seen) AS evidence FROM w GROUP BY ALL)
SELECT a.artifact, a.seq, coalesce(class, 'unknown') AS runtime, CASE WHEN score >= 30 AND score >= second * 2 THEN 'high' WHEN score >= 10 THEN 'medium' ELSE 'low' END AS confidence,
  CAST(coalesce(score, 0) AS BIGINT) AS score, CAST(coalesce(second, 0) AS BIGINT) AS runner_up, coalesce(evidence, '') AS evidence
FROM (SELECT DISTINCT artifact, seq FROM f) a LEFT JOIN r ON r.artifact = a.artifact AND r.seq = a.seq AND rn = 1 LEFT JOIN e ON e.artifact = a.artifact AND e.seq = a.seq""")
def score_classes(spark, sf):
    return extract.score_runtimes(adapters.code_files(spark, sf))


@query("shallow_first_topk", f"""SELECT artifact, seq, path, CAST(row_number() OVER (PARTITION BY artifact, seq ORDER BY length(path) - length(replace(path, '/', '')), length(path), path) AS BIGINT) AS rank FROM ({CODE}) QUALIFY rank <= 5""")
def shallow_first_topk(spark, sf):
    """The files a capped scan would open first."""
    from ..functions import paths
    from ..operators.ordered import top_per_group

    files = adapters.code_files(spark, sf).select("artifact", "seq", "path")
    order = [paths.depth(F.col("path")), F.length("path"), F.col("path")]
    return top_per_group(files, ["artifact", "seq"], order, 5).withColumn("rank", F.col("rank").cast("bigint"))


def _severity_rank_sql(c: str) -> str:
    return f"CASE {c} WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


def _findings_sql(source: str, keys: str) -> str:
    parts = []
    for rule in findings.RULES:
        values = f"regexp_extract_all(line, {sql_text(rule.regex)}, 2)"
        if rule.placeholders:
            values = f"list_filter({values}, lambda v: NOT regexp_matches(v, {sql_text(findings.PLACEHOLDER)}))"
        detail = "v" if rule.show_whole else "substr(v, 1, 4) || '…' || right(v, 2) || ' (' || length(v) || ' chars)'"
        parts.append(f"SELECT {keys}, '{rule.kind}' AS kind, '{rule.severity}' AS severity, CAST(line_no AS INTEGER) AS line_no, {detail} AS detail FROM (SELECT {keys}, line_no, unnest({values}) AS v FROM ({source}))")
    return " UNION ALL ".join(parts)


FINDINGS_SQL = f"nl AS ({sql_numbered(FILES, 'artifact, seq, path')}), fi AS ({_findings_sql('SELECT * FROM nl', 'artifact, seq, path')}), fv AS (SELECT *, {sql_vendored('path')} AS is_vendor FROM fi)"


def found(spark, sf):
    return findings.findings(adapters.snapshot_files(spark, sf))


@query("findings", f"WITH {FINDINGS_SQL} SELECT * FROM fv")
def findings_query(spark, sf):
    return found(spark, sf)


@query("findings_ranked", f"WITH {FINDINGS_SQL} SELECT *, CAST({_severity_rank_sql('severity')} AS INTEGER) AS severity_rank FROM fv WHERE NOT is_vendor")
def findings_ranked(spark, sf):
    """First-party findings with the rank that lists the worst first."""
    return found(spark, sf).where(~F.col("is_vendor")).withColumn("severity_rank", findings.severity_rank(F.col("severity")))


@query("findings_delta", f"""WITH {FINDINGS_SQL}, o AS (SELECT * FROM fv WHERE seq = 1), n AS (SELECT * FROM fv WHERE seq = 2)
SELECT artifact, path, kind, severity, line_no, detail, 'new' AS status FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.artifact = n.artifact AND o.kind = n.kind AND o.path = n.path AND o.detail = n.detail)
UNION ALL SELECT artifact, path, kind, severity, line_no, detail, 'fixed' FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.artifact = n.artifact AND o.kind = n.kind AND o.path = n.path AND o.detail = n.detail)""")
def findings_delta(spark, sf):
    rows = found(spark, sf).select("artifact", "seq", "path", "kind", "severity", "line_no", "detail")
    old, new = (rows.where(F.col("seq") == s).drop("seq") for s in (1, 2))
    return sets.findings_delta(old, new, ["artifact", "kind", "path", "detail"])


@query("severity_summary", f"""WITH {FINDINGS_SQL}, la AS (SELECT artifact, max(seq) AS seq FROM ({FILES}) GROUP BY artifact)
SELECT la.artifact, la.seq, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity NOT IN ('high', 'medium', 'low')) AS other
FROM la LEFT JOIN fv ON fv.artifact = la.artifact AND fv.seq = la.seq AND NOT is_vendor GROUP BY ALL""")
def severity_summary(spark, sf):
    """First-party findings of the latest version per severity."""
    files = adapters.snapshot_files(spark, sf)
    latest = files.groupBy("artifact").agg(F.max("seq").alias("seq"))
    severity = F.col("severity")
    counts = found(spark, sf).where(~F.col("is_vendor")).groupBy("artifact", "seq").agg(
        *[facts.count_if(severity == s).alias(s) for s in findings.SEVERITY_ORDER], facts.count_if(~severity.isin(*findings.SEVERITY_ORDER)).alias("other"))
    return latest.join(counts, ["artifact", "seq"], "left").na.fill(0)


def _entropy_sql(t: str) -> str:
    chars = f"string_split({t}, '')"
    return f"round(list_sum(list_transform(list_distinct({chars}), lambda c: -(len(list_filter({chars}, lambda x: x = c)) / length({t})::DOUBLE) * log2(len(list_filter({chars}, lambda x: x = c)) / length({t})::DOUBLE))), 6)"


def _random_sql(t: str) -> str:
    return f"({_entropy_sql(t)} >= 4.0 AND regexp_matches({t}, '[0-9]') AND regexp_matches({t}, '[A-Za-z]'))"


_WORD_TOKEN = "regexp_extract_all(text, '[A-Za-z0-9+/_=-]{8,}', 0)"


@query("token_entropy", f"SELECT doc_id, token, {_entropy_sql('token')} AS entropy FROM (SELECT DISTINCT doc_id, unnest({_WORD_TOKEN}) AS token FROM documents)")
def token_entropy(spark, sf):
    from ..functions import text

    docs = spread(spark, sf, "documents", "doc_id").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{8,}"), F.lit(0)))).alias("token"))
    return docs.withColumn("entropy", F.round(text.shannon_entropy(F.col("token")), 6))


# Text with a run no rule names, so that the entropy test has something to find.
_WITH_RUNS = "text || chr(10) || 'k: ' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 20) || 'XyZwVuTsRqPo' || doc_id || ' h: ' || sha256(text)"


def with_runs(spark, sf):
    d = F.col("doc_id").cast("string")
    return spread(spark, sf, "documents", "doc_id").select("doc_id", F.concat(
        "text", F.lit("\nk: "), F.substring(F.sha2(d, 256), 1, 20), F.lit("XyZwVuTsRqPo"), d, F.lit(" h: "), F.sha2("text", 256)).alias("content"))


@query("entropy_tokens", f"SELECT doc_id, token, {_entropy_sql('token')} AS entropy, {_random_sql('token')} AS is_random FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(content, {sql_text(findings.TOKENISH)}, 0)) AS token FROM (SELECT doc_id, {_WITH_RUNS} AS content FROM documents))")
def entropy_tokens(spark, sf):
    return findings.tokens(with_runs(spark, sf), ["doc_id"], "content")


def _redact_sql(source: str, keys: str) -> str:
    inner = f"SELECT {keys}, content AS c, 0 AS n FROM ({source})"
    for rule in findings.RULES:
        inner = (f"SELECT {keys}, regexp_replace(c, {sql_text(rule.regex)}, '\\1«redacted {rule.kind}»\\3', 'g') AS c, "
                 f"n + len(regexp_extract_all(c, {sql_text(rule.regex)}, 0)) AS n FROM ({inner})")
    runs = f"SELECT *, list_transform(regexp_extract_all(c, {sql_text(findings.TOKENISH)}, 0), lambda t: {{'t': t, 'r': {_random_sql('t')}}}) AS runs, string_split_regex(c, {sql_text(findings.TOKENISH)}) AS parts FROM ({inner})"
    return f"""SELECT {keys}, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(CASE WHEN runs[i].r THEN '{findings.TOKEN_MARK}' ELSE runs[i].t END, '')), '') AS redacted,
  CAST(n + len(list_filter(runs, lambda e: e.r)) AS BIGINT) AS redactions FROM ({runs})"""


@query("redact_text", _redact_sql(f"SELECT doc_id, {_WITH_RUNS} AS content FROM documents", "doc_id"))
def redact_text(spark, sf):
    return findings.redact(with_runs(spark, sf), "content").select("doc_id", "redacted", "redactions")


@query("line_delta", f"""WITH {PAIR_LINES_SQL} SELECT p.artifact, p.path, added_lines, removed_lines FROM ps p
JOIN files o ON o.artifact = p.artifact AND o.path = p.path AND o.seq = 1 JOIN files n ON n.artifact = p.artifact AND n.path = p.path AND n.seq = 2 WHERE o.content <> n.content""")
def line_delta(spark, sf):
    return similar.pair_similarity(modified_sides(spark, sf), ["artifact", "path"]).select("artifact", "path", "added_lines", "removed_lines")


@query("whitespace_only_changes", f"""WITH files AS ({FILES}) SELECT o.artifact, o.path FROM files o JOIN files n ON o.artifact = n.artifact AND o.path = n.path AND o.seq = 1 AND n.seq = 2
WHERE o.content <> n.content AND o.content <> '' AND n.content <> '' AND {sql_whitespace_key('o.content')} = {sql_whitespace_key('n.content')}""")
def whitespace_only_changes(spark, sf):
    pairs = lines.paired_texts(modified_sides(spark, sf), ["artifact", "path"])
    return pairs.where(lines.is_whitespace_only(F.col("old_content"), F.col("new_content"))).select("artifact", "path")


KEYS = "artifact, path"
EDITED_SQL = f"""files AS ({FILES}), ed AS (SELECT o.artifact, o.path, o.content AS oc, n.content AS nc,
  o.content <> '' AND n.content <> '' AND {sql_whitespace_key('o.content')} = {sql_whitespace_key('n.content')} AS ws,
  greatest(length(replace(o.content, chr(10), '')) / nullif({sql_line_count('o.content')}, 0), length(replace(n.content, chr(10), '')) / nullif({sql_line_count('n.content')}, 0)) > 400 AS wide
  FROM files o JOIN files n ON o.artifact = n.artifact AND o.path = n.path AND o.seq = 1 AND n.seq = 2 WHERE o.content <> n.content)"""
SCRIPT_SQL = f"""{EDITED_SQL}, it AS (SELECT {KEYS}, is_new, unnest(range(1, len(l) + 1)) AS no, unnest(l) AS item FROM (
    SELECT {KEYS}, false AS is_new, {sql_lines('oc')} AS l FROM ed WHERE NOT ws AND NOT coalesce(wide, false) UNION ALL SELECT {KEYS}, true, {sql_lines('nc')} FROM ed WHERE NOT ws AND NOT coalesce(wide, false))),
{sql_script('it', KEYS)}"""
_TOKENS = "regexp_extract_all({}, '([\\p{{L}}\\p{{N}}_]+|\\s+|.)', 1)"


def edited_texts(spark, sf):
    return lines.paired_texts(modified_sides(spark, sf), ["artifact", "path"])


@query("line_ops", f"""WITH {SCRIPT_SQL},
pl AS (SELECT *, CASE WHEN op = 'add' THEN coalesce(max(CASE WHEN op = 'del' THEN old_no END) OVER (PARTITION BY {KEYS}, gap), gap) ELSE old_no END AS a, CASE WHEN op = 'add' THEN new_no ELSE 0 END AS b FROM script),
rk AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY a, b) AS r FROM pl),
nr AS (SELECT *, max(CASE WHEN op <> 'keep' THEN r END) OVER (PARTITION BY {KEYS} ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up,
  min(CASE WHEN op <> 'keep' THEN r END) OVER (PARTITION BY {KEYS} ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS down FROM rk),
sh AS (SELECT *, CASE WHEN r - coalesce(lag(r) OVER (PARTITION BY {KEYS} ORDER BY r), -1) > 1 THEN 1 ELSE 0 END AS fresh FROM nr WHERE coalesce(r - up <= 3, false) OR coalesce(down - r <= 3, false))
SELECT {KEYS}, CAST(sum(fresh) OVER (PARTITION BY {KEYS} ORDER BY r) AS INTEGER) AS hunk, op, old_no, new_no, item AS line FROM sh""")
def line_ops(spark, sf):
    """Ordered line operations of every edited file, three lines around each change."""
    return lines.line_ops(edited_texts(spark, sf), ["artifact", "path"])


_WORDS_A, _WORDS_B = (f"list_distinct({_TOKENS.format(c)})" for c in ("d.item", "a.item"))


@query("pair_lines", f"""WITH {SCRIPT_SQL},
sd AS (SELECT *, row_number() OVER (PARTITION BY {KEYS}, gap, op ORDER BY coalesce(old_no, new_no)) AS n FROM script WHERE op <> 'keep'),
bo AS (SELECT d.artifact, d.path, d.old_no, a.new_no, d.item AS before, a.item AS after, CASE WHEN len({_WORDS_A}) + len({_WORDS_B}) = 0 THEN 1.0::DOUBLE
  ELSE round(2.0::DOUBLE * len(list_intersect({_WORDS_A}, {_WORDS_B})) / (len({_WORDS_A}) + len({_WORDS_B})), 6) END AS ratio
  FROM sd d JOIN sd a ON a.artifact = d.artifact AND a.path = d.path AND a.gap = d.gap AND a.n = d.n AND d.op = 'del' AND a.op = 'add')
SELECT {KEYS}, old_no, new_no, ratio, before, after FROM bo WHERE ratio >= 0.5""")
def pair_lines(spark, sf):
    """Rewritten lines of every edited file, paired inside each gap of kept lines."""
    return lines.pair_lines(lines.line_script(edited_texts(spark, sf), ["artifact", "path"], context=0), ["artifact", "path"])


@query("long_line_edits", f"""WITH {EDITED_SQL}, wd AS (SELECT *, {sql_shared_prefix('oc', 'nc')} AS head FROM ed WHERE wide),
wt AS (SELECT *, least({sql_shared_prefix('reverse(oc)', 'reverse(nc)')}, least(length(oc), length(nc)) - head) AS tail FROM wd),
mi AS (SELECT {KEYS}, nc, head, substr(oc, head + 1, length(oc) - head - tail) AS was, substr(nc, head + 1, length(nc) - head - tail) AS now FROM wt),
it AS (SELECT {KEYS}, is_new, unnest(range(1, len(l) + 1)) AS no, unnest(l) AS item FROM (SELECT {KEYS}, false AS is_new, {_TOKENS.format('was')} AS l FROM mi UNION ALL SELECT {KEYS}, true, {_TOKENS.format('now')} FROM mi)),
{sql_script('it', KEYS)},
po AS (SELECT *, CAST(coalesce(sum(length(item)) OVER (PARTITION BY {KEYS} ORDER BY new_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM script WHERE new_no IS NOT NULL),
ga AS (SELECT {KEYS}, gap, coalesce(string_agg(item, '' ORDER BY old_no) FILTER (op = 'del'), '') AS before, coalesce(string_agg(item, '' ORDER BY new_no) FILTER (op = 'add'), '') AS after FROM script WHERE op <> 'keep' GROUP BY ALL),
ad AS (SELECT {KEYS}, gap, min(start) AS s FROM po WHERE op = 'add' GROUP BY ALL), ke AS (SELECT {KEYS}, old_no AS gap, start + length(item) AS s FROM po WHERE op = 'keep'),
el AS (SELECT {KEYS}, CAST(head + coalesce(ad.s, ke.s, 0) AS BIGINT) AS spot, before, after, nc FROM ga LEFT JOIN ad USING ({KEYS}, gap) LEFT JOIN ke USING ({KEYS}, gap) JOIN mi USING ({KEYS}))
SELECT {KEYS}, spot AS at, before, after, substr(nc, greatest(spot - 24, 0) + 1, spot - greatest(spot - 24, 0)) AS lead, substr(nc, spot + length(after) + 1, 24) AS trail FROM el""")
def long_line_edits(spark, sf):
    """Separate word edits of every edited file with long lines."""
    pairs = edited_texts(spark, sf).where(lines.is_wide(F.col("old_content"), F.col("new_content")))
    return lines.long_line_edits(pairs, ["artifact", "path"])


STEPS_SQL = f"st AS (SELECT * FROM (SELECT artifact, lag(seq) OVER w AS old_seq, seq AS new_seq, lag(content) OVER w AS old_content, content AS new_content FROM ({TURNS}) WINDOW w AS (PARTITION BY artifact ORDER BY seq)) WHERE old_seq IS NOT NULL)"
STEP = ["artifact", "old_seq", "new_seq"]


def steps(spark, sf):
    return lines.step_texts(adapters.turns(spark, sf))


@query("token_delta", f"""WITH {STEPS_SQL},
t AS (SELECT artifact, old_seq, new_seq, 0 AS side, unnest(regexp_extract_all(old_content, '([\\p{{L}}\\p{{N}}_]+|\\s+|.)', 1)) AS token FROM st UNION ALL SELECT artifact, old_seq, new_seq, 1, unnest(regexp_extract_all(new_content, '([\\p{{L}}\\p{{N}}_]+|\\s+|.)', 1)) FROM st),
c AS (SELECT artifact, old_seq, new_seq, token, count(*) FILTER (side = 0) AS co, count(*) FILTER (side = 1) AS cn FROM t GROUP BY ALL)
SELECT artifact, old_seq, new_seq, CAST(sum(co) AS BIGINT) AS old_tokens, CAST(sum(cn) AS BIGINT) AS new_tokens, CAST(sum(least(co, cn)) AS BIGINT) AS shared, CAST(sum(greatest(cn - co, 0)) AS BIGINT) AS added_tokens,
  CAST(sum(greatest(co - cn, 0)) AS BIGINT) AS removed_tokens, round(2.0::DOUBLE * sum(least(co, cn)) / (sum(co) + sum(cn)), 6) AS similarity FROM c GROUP BY ALL""")
def token_delta(spark, sf):
    return lines.token_delta(steps(spark, sf), STEP)


SPAN_SQL = f"""{STEPS_SQL}, sp AS (SELECT *, CAST({sql_shared_prefix('old_content', 'new_content')} AS INTEGER) AS head FROM st),
sq AS (SELECT *, CAST(least({sql_shared_prefix('reverse(old_content)', 'reverse(new_content)')}, least(length(old_content), length(new_content)) - head) AS INTEGER) AS tail FROM sp),
sr AS (SELECT *, substr(old_content, head + 1, length(old_content) - head - tail) AS was, substr(new_content, head + 1, length(new_content) - head - tail) AS now FROM sq)"""


@query("changed_span", f"WITH {SPAN_SQL} SELECT artifact, old_seq, new_seq, head, tail, was, now FROM sr")
def changed_span(spark, sf):
    return lines.with_changed_span(steps(spark, sf)).select(*STEP, "head", "tail", "was", "now")


@query("span_excerpt", f"""WITH {SPAN_SQL} SELECT artifact, old_seq, new_seq, reason, CASE WHEN reason IS NULL THEN head END AS at, CASE WHEN reason IS NULL THEN was END AS before, CASE WHEN reason IS NULL THEN now END AS after,
CASE WHEN reason IS NULL THEN substr(new_content, greatest(head - 24, 0) + 1, head - greatest(head - 24, 0)) END AS lead, CASE WHEN reason IS NULL THEN substr(new_content, head + length(now) + 1, 24) END AS trail
FROM (SELECT *, CASE WHEN old_content = new_content THEN 'no textual change' END AS reason FROM sr)""")
def span_excerpt(spark, sf):
    return lines.span_excerpt(steps(spark, sf)).drop("old_content", "new_content")


@query("line_budget", f"""WITH l AS ({sql_numbered("SELECT doc_id, text AS content FROM documents", 'doc_id')}), r AS (SELECT doc_id, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) <= 1500 AND line_no <= 40 AS fits FROM l)
SELECT doc_id, count(*) FILTER (fits) AS kept, count(*) FILTER (NOT fits) AS dropped, CAST(coalesce(sum(length(line) + 1) FILTER (fits), 0) AS BIGINT) AS kept_chars FROM r GROUP BY doc_id""")
def line_budget(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return lines.line_budget(extract.numbered_lines(docs, ["doc_id"]), ["doc_id"], 1500, 40)


@query("truncate_groups", f"""SELECT page_id, position, line, n > 3 AS truncated FROM (SELECT page_id, line_no AS position, line, count(*) OVER (PARTITION BY page_id) AS n FROM ({sql_numbered("SELECT page_id, replace(html, '><', '>' || chr(10) || '<') AS content FROM pages", 'page_id')})) WHERE position <= 3""")
def truncate_groups(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.replace("html", F.lit("><"), F.lit(">\n<")).alias("content"))
    return lines.truncate_groups(extract.numbered_lines(pages, ["page_id"]), ["page_id"], [F.col("line_no")], 3).drop("line_no")


_REQUIREMENT_LINES = "CASE p_partkey % 8 WHEN 0 THEN replace(p_name, ' ', '-') || '==' || p_size || '.0' WHEN 1 THEN replace(p_name, ' ', '_') || '[extra] >= ' || p_size || ' ; python_version > \"3\"' WHEN 2 THEN '# ' || p_name WHEN 3 THEN '-r base' || p_partkey || '.txt' WHEN 4 THEN 'https://example.com/' || replace(p_name, ' ', '/') || '.zip?x=1' WHEN 5 THEN replace(p_name, ' ', '-') || ' @ https://example.com/' || p_partkey WHEN 6 THEN '  ' || replace(p_name, ' ', '.') || '  # pinned' ELSE '' END"
_REQ = sql_text(dependency_ops.REQUIREMENT)


@query("parse_requirements", f"""
SELECT p_partkey, CASE WHEN regexp_matches(s, '^(git\\+|https?://)') THEN string_split(regexp_replace(regexp_replace(s, '\\?.*$', ''), '/+$', ''), '/')[-1] WHEN contains(s, ' @ ') THEN trim(string_split(s, ' @ ')[1]) ELSE regexp_extract(s, {_REQ}, 1) END AS name,
  CASE WHEN regexp_matches(s, '^(git\\+|https?://)') THEN NULL WHEN contains(s, ' @ ') THEN trim(string_split(s, ' @ ')[2]) WHEN regexp_extract(s, {_REQ}, 2) <> '' THEN nullif(regexp_extract(s, {_REQ}, 3), '') END AS version
FROM (SELECT p_partkey, trim(regexp_replace({_REQUIREMENT_LINES}, '#.*$', '')) AS s FROM part) WHERE s <> '' AND NOT starts_with(s, '-')""")
def parse_requirements(spark, sf):
    parts = spread(spark, sf, "part", "p_partkey").select("p_partkey", F.expr(_REQUIREMENT_LINES.replace('\\"', '"').replace("\"3\"", '"3"')).alias("content"))
    return parts.select("p_partkey", F.explode(dependency_ops.requirements(F.col("content"))).alias("d")).select("p_partkey", "d.name", "d.version")
