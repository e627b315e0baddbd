"""Projections, filters and scalar text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, paths, text
from ..options import IGNORE_GLOBS, STRIP_PATTERNS, VENDOR_GLOBS, ArrivalOptions
from ..sources import adapters
from .registry import query

table, spread = adapters.table, adapters.spread_table
FILES = adapters.SNAPSHOT_FILES_SQL


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_dirname(path: str) -> str:
    return f"regexp_extract({path}, '^(.*)/[^/]*$', 1)"


def sql_basename(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def sql_extension(path: str) -> str:
    return f"lower(regexp_extract({sql_basename(path)}, '^.+(\\.[^.]+)$', 1))"


def sql_line_count(c: str) -> str:
    return f"(length({c}) - length(replace({c}, chr(10), '')) + CASE WHEN {c} <> '' AND NOT ends_with({c}, chr(10)) THEN 1 ELSE 0 END)"


def sql_lines(c: str) -> str:
    """Mirror of functions.text.lines_of."""
    return (f"(CASE WHEN {c} = '' THEN CAST([] AS VARCHAR[]) WHEN ends_with({c}, chr(10)) "
            f"THEN string_split({c}[1:-2], chr(10)) ELSE string_split({c}, chr(10)) END)")


def sql_language(path: str) -> str:
    cases = " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in paths.LANGUAGE_BY_EXTENSION.items())
    ext, name = sql_extension(path), f"lower({sql_basename(path)})"
    bare = ", ".join(f"'{n}'" for n in paths.BARE_NAMES)
    return (f"CASE WHEN {ext} <> '' THEN coalesce(CASE {ext} {cases} ELSE NULL END, substr({ext}, 2)) "
            f"WHEN {name} IN ({bare}) THEN {name} ELSE 'text' END")


def sql_vendored(path: str) -> str:
    return f"regexp_full_match({path}, {sql_text(paths.glob_regex(VENDOR_GLOBS))})"


def sql_ignored(path: str) -> str:
    return f"regexp_full_match({path}, {sql_text(paths.glob_regex(IGNORE_GLOBS))})"


def sql_whitespace_key(c: str) -> str:
    return (f"array_to_string(list_filter(list_transform(string_split({c}, chr(10)), "
            f"lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))")


def sql_shared_prefix(a: str, b: str) -> str:
    """Longest shared prefix; relies on list_position of the first difference."""
    shorter = f"least(length({a}), length({b}))"
    flags = (f"list_transform(range(1, CAST({shorter} AS BIGINT) + 1), "
             f"lambda i: substr({a}, CAST(i AS BIGINT), 1) = substr({b}, CAST(i AS BIGINT), 1))")
    return f"coalesce(nullif(list_position({flags}, false), 0) - 1, {shorter})"


# A file name with a language extension or a bare name, spread over doc ids.
_NAMES = (".py", ".ts", ".JS", ".rst", "Dockerfile", "makefile", ".env", ".java", "noext", ".tar.gz", ".yml")


def _named_path(ids, base):
    out = None
    for i, suffix in enumerate(_NAMES):
        bare = not suffix.startswith(".") or suffix == ".env"
        value = F.concat(base, F.lit("/" + suffix) if bare else F.concat(F.lit("/f"), ids.cast("string"), F.lit(suffix)))
        out = F.when(ids % len(_NAMES) == i, value) if out is None else out.when(ids % len(_NAMES) == i, value)
    return out


def _named_path_sql(ids: str, base: str) -> str:
    parts = []
    for i, suffix in enumerate(_NAMES):
        bare = not suffix.startswith(".") or suffix == ".env"
        value = f"{base} || '/{suffix}'" if bare else f"{base} || '/f' || {ids} || '{suffix}'"
        parts.append(f"WHEN {ids} % {len(_NAMES)} = {i} THEN {value}")
    return "CASE " + " ".join(parts) + " END"


@query("candidate_filter", """
SELECT page_id, name, suffix, CASE WHEN starts_with(name, '.') OR starts_with(name, '~$') THEN 'hidden'
    WHEN suffix IN ('.crdownload', '.part', '.download', '.tmp', '.partial', '.opdownload') THEN 'partial'
    WHEN suffix = '.zip' THEN 'candidate'
    WHEN suffix IN ('.jar', '.war', '.tar', '.tgz', '.gz', '.7z', '.rar') THEN 'archive of another kind'
    ELSE 'other' END AS verdict
FROM (SELECT page_id, name, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS suffix
  FROM (SELECT page_id, (CASE page_id % 7 WHEN 0 THEN '.' WHEN 1 THEN '~$' ELSE '' END)
    || replace(url, '/', '_')
    || (CASE page_id % 5 WHEN 0 THEN '.zip' WHEN 1 THEN '.ZIP' WHEN 2 THEN '.zip.crdownload' WHEN 3 THEN '.tar' ELSE '.pdf' END) AS name
    FROM pages))""")
def candidate_filter(spark, sf):
    from ..operators.arrivals import candidate_verdict

    key = F.col("page_id")
    prefix = F.when(key % 7 == 0, ".").when(key % 7 == 1, "~$").otherwise("")
    ending = F.when(key % 5 == 0, ".zip").when(key % 5 == 1, ".ZIP").when(key % 5 == 2, ".zip.crdownload").when(key % 5 == 3, ".tar").otherwise(".pdf")
    pages = table(spark, sf, "pages").select(
        "page_id", F.concat(prefix, F.replace("url", F.lit("/"), F.lit("_")), ending).alias("name"))
    return pages.select("page_id", "name", paths.extension(F.col("name")).alias("suffix"),
                        candidate_verdict(F.col("name"), ArrivalOptions()).alias("verdict"))


@query("text_sniff", """
WITH h AS (SELECT page_id, page_id % 5 AS k, html, hex(encode(html)) AS u FROM pages),
b AS (SELECT page_id, CASE k WHEN 0 THEN u WHEN 1 THEN '' WHEN 2 THEN substr(u, 1, 20) || '00' || substr(u, 21)
  WHEN 3 THEN array_to_string(list_transform(range(1, length(html) + 1), lambda i: CASE WHEN unicode(html[i]) < 256 THEN lpad(hex(unicode(html[i])), 2, '0') ELSE '3F' END), '')
  ELSE upper(sha256(html)) || u END AS bytes FROM h),
p AS (SELECT *, list_transform(range(0, length(bytes) // 2), lambda i: bytes[2 * i + 1:2 * i + 2]) AS pairs FROM b)
SELECT page_id, CASE WHEN bytes = '' THEN true WHEN list_contains(pairs, '00') THEN false WHEN TRY(decode(unhex(bytes))) IS NOT NULL THEN true
  ELSE len(list_filter(pairs, lambda x: x IN ('09', '0A', '0D') OR (x >= '20' AND x <= '7E'))) / len(pairs)::DOUBLE > 0.85 END AS is_text
FROM p""")
def text_sniff(spark, sf):
    """Whole pages as UTF-8, emptied, with a NUL, as Latin-1, and behind the bytes of a digest."""
    key = F.col("page_id")
    raw = F.encode("html", "UTF-8")
    latin = F.encode(F.regexp_replace("html", r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    payload = (
        F.when(key % 5 == 0, raw).when(key % 5 == 1, F.encode(F.lit(""), "UTF-8"))
        .when(key % 5 == 2, F.concat(F.substring(raw, 1, 10), F.unhex(F.lit("00")), F.substring(raw, F.lit(11), F.octet_length(raw))))
        .when(key % 5 == 3, latin).otherwise(F.concat(F.unhex(F.sha2("html", 256)), raw))
    )
    return table(spark, sf, "pages").select("page_id", text.is_probably_text(payload).alias("is_text"))


@query("language_label", f"SELECT doc_id, path, {sql_language('path')} AS lang FROM (SELECT doc_id, {_named_path_sql('doc_id', 'source')} AS path FROM documents)")
def language_label(spark, sf):
    path = _named_path(F.col("doc_id"), F.col("source"))
    return table(spark, sf, "documents").select("doc_id", path.alias("path")).withColumn("lang", paths.language_label(F.col("path")))


_VENDOR_PATH = ("CASE doc_id % 9 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'a/node_modules/' WHEN 2 THEN 'x/site-packages/' "
                "WHEN 3 THEN 'dist-info/' WHEN 4 THEN 'b-1.0.dist-info/' WHEN 5 THEN 'myvendor/' WHEN 6 THEN 'vendor/' "
                "WHEN 7 THEN '.venv/' ELSE 'src/' END || source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pyc' WHEN 1 THEN '/yarn.lock' ELSE '.py' END")


@query("vendor_flag", f"""SELECT doc_id, path, {sql_vendored('path')} AS is_vendor, {sql_ignored('path')} AS is_ignored
FROM (SELECT doc_id, {_VENDOR_PATH} AS path FROM documents)""")
def vendor_flag(spark, sf):
    path = F.expr(_VENDOR_PATH)
    return table(spark, sf, "documents").select("doc_id", path.alias("path")).select(
        "doc_id", "path", paths.is_vendored(F.col("path")).alias("is_vendor"),
        paths.matches_any(F.col("path"), IGNORE_GLOBS).alias("is_ignored"))


@query("line_counts", f"""SELECT doc_id, CAST({sql_line_count('text')} AS BIGINT) AS lines,
  CASE WHEN {sql_line_count('text')} > 0 THEN round((length(text) - (length(text) - length(replace(text, chr(10), '')))) * 1.0::DOUBLE / {sql_line_count('text')}, 6) ELSE 0.0::DOUBLE END AS mean_length
FROM documents""")
def line_counts(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.line_count(F.col("text")).alias("lines"), F.round(text.mean_line_length(F.col("text")), 6).alias("mean_length"))


def _slug_sql(c: str) -> str:
    folded = f"regexp_replace(translate({c}, '{paths.ACCENTED}', '{paths.FOLDED}'), '[^\\x00-\\x7F]', '', 'g')"
    slug = f"regexp_replace({folded}, '[^A-Za-z0-9._-]+', '-', 'g')"
    slug = f"regexp_replace({slug}, '^[-._]+|[-._]+$', '', 'g')"
    return f"regexp_replace({slug}, '-{{2,}}', '-', 'g')"


_SLUG_CHECK = """
SELECT kind, id, raw, CASE WHEN regexp_full_match(upper(string_split(slug, '.')[1]), 'CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]')
  THEN '_' || slug ELSE slug END AS slug
FROM (SELECT kind, id, raw, CASE WHEN s = '' THEN 'unnamed' ELSE s END AS slug FROM (
  SELECT *, """ + _slug_sql("raw") + """ AS s FROM (
    SELECT 'part' AS kind, p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN 'con.' || p_name WHEN p_partkey % 50 = 1 THEN '***' ELSE p_name || ' (' || p_brand || ')' END AS raw FROM part
    UNION ALL SELECT 'document', doc_id, text FROM documents)))"""


@query("slugify_names", _SLUG_CHECK)
def slugify_names(spark, sf):
    key = F.col("p_partkey")
    raw = F.when(key % 50 == 0, F.concat(F.lit("con."), F.col("p_name"))).when(key % 50 == 1, F.lit("***")).otherwise(
        F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")))
    parts = table(spark, sf, "part").select(F.lit("part").alias("kind"), key.alias("id"), raw.alias("raw"))
    docs = table(spark, sf, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("raw"))
    return parts.unionByName(docs).withColumn("slug", paths.slugify(F.col("raw")))


_STEMS = ("CASE o_orderkey % 9 WHEN 0 THEN 'orders-fn (' || o_orderkey || ')' "
          "WHEN 1 THEN 'orders_' || strftime(o_orderdate, '%Y-%m-%d') || ' (1)' "
          "WHEN 2 THEN 'billing-' || strftime(o_orderdate, '%Y%m%d') || '-1030' "
          "WHEN 3 THEN 'svc-' || sha256(CAST(o_orderkey AS VARCHAR)) WHEN 4 THEN 'repo-v1.' || o_orderkey || '.0' "
          "WHEN 5 THEN 'repo-main-copy' || o_orderkey || '-final' WHEN 6 THEN 'api-' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) || '-latest' "
          "WHEN 7 THEN 'word-defaced' || '-v' || (o_orderkey % 7) ELSE 'job_' || (1700000000 + o_orderkey) END")


def _clean_sql(source: str) -> str:
    """Four passes as nested subselects."""
    inner = f"SELECT id, raw, trim(raw) AS s FROM ({source})"
    for _ in range(4):
        expr = "s"
        for pattern in STRIP_PATTERNS:
            expr = f"trim(regexp_replace({expr}, {sql_text(pattern)}, ''))"
        inner = f"SELECT id, raw, {expr} AS s FROM ({inner})"
        tail = "regexp_extract(s, '[-_]([0-9a-f]{7,12})$', 1)"
        inner = (f"SELECT id, raw, regexp_replace(CASE WHEN regexp_matches({tail}, '[0-9]') "
                 f"THEN trim(regexp_replace(s, '[-_][0-9a-f]{{7,12}}$', '')) ELSE s END, '^[ \\-_.]+|[ \\-_.]+$', '', 'g') AS s FROM ({inner})")
    return inner


@query("clean_names", f"SELECT id, raw, s AS name FROM ({_clean_sql(f'SELECT o_orderkey AS id, {_STEMS} AS raw FROM orders')})")
def clean_names(spark, sf):
    raw = F.expr(_STEMS.replace("strftime(o_orderdate, '%Y-%m-%d')", "date_format(o_orderdate, 'yyyy-MM-dd')")
                 .replace("strftime(o_orderdate, '%Y%m%d')", "date_format(o_orderdate, 'yyyyMMdd')")
                 .replace("sha256(CAST(o_orderkey AS VARCHAR))", "sha2(CAST(o_orderkey AS STRING), 256)"))
    orders = spread(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("id"), raw.alias("raw"))
    return orders.withColumn("name", paths.clean_name(F.col("raw")))


_REFS = ("CASE o_orderkey % 7 WHEN 0 THEN 'repo-1.' || o_orderkey || '.3' WHEN 1 THEN 'repo-v2.' || o_orderkey WHEN 2 THEN 'repo_main' "
         "WHEN 3 THEN 'repo-' || {hash} WHEN 4 THEN 'repo-' || o_orderkey WHEN 5 THEN ' repo-2.0-rc' || o_orderkey || ' ' ELSE 'repo-v' || o_orderkey END")


@query("ref_labels", f"""SELECT id, raw, CASE WHEN ref = '' THEN NULL WHEN regexp_matches(ref, '^[0-9]') THEN 'v' || ref ELSE ref END AS ref
FROM (SELECT id, raw, regexp_extract(trim(raw), {sql_text(paths.REF_PATTERN)}, 1) AS ref
FROM (SELECT o_orderkey AS id, {_REFS.format(hash="substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 7)")} AS raw FROM orders))""")
def ref_labels(spark, sf):
    raw = F.expr(_REFS.format(hash="substr(sha2(CAST(o_orderkey AS STRING), 256), 1, 7)"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw")).withColumn(
        "ref", paths.ref_label(F.col("raw")))


_OLD_NAME = "'src/' || lower(p_type) || '/' || replace(p_name, ' ', '-') || '-1.' || (p_partkey % 13) || '.0/METADATA.txt'"
_NEW_NAME = ("CASE p_partkey % 4 WHEN 0 THEN 'src/' || lower(p_type) || '/' || replace(p_name, ' ', '-') || '-1.' || (p_partkey % 7) || '.5/METADATA.txt' "
             "WHEN 1 THEN 'src/' || lower(p_brand) || '/' || replace(p_name, ' ', '-') || '-1.' || (p_partkey % 13) || '.0/METADATA.txt' "
             "WHEN 2 THEN 'other' ELSE 'src/' || lower(p_type) || '/' || replace(p_name, ' ', '-') || '-1.' || (p_partkey % 13) || '.0/METADATA.txt.bak' END")


def _after_last_separator(c: str) -> str:
    return f"length(regexp_extract({c}, '^(.*[/\\-_.])[^/\\-_.]*$', 1))"


def sql_rename_parts(source: str) -> str:
    """Adds prefix, was, now, suffix to rows with old_path and new_path."""
    return f"""
SELECT * EXCLUDE (hc, h, ro, rn, tt, t), substr(old_path, 1, h) AS prefix, substr(ro, 1, length(ro) - t) AS was,
  substr(rn, 1, length(rn) - t) AS now, substr(ro, length(ro) - t + 1) AS suffix
FROM (SELECT *, {_after_last_separator('tt')} AS t
FROM (SELECT *, substr(reverse(ro), 1, {sql_shared_prefix('reverse(ro)', 'reverse(rn)')}) AS tt
FROM (SELECT *, substr(old_path, h + 1) AS ro, substr(new_path, h + 1) AS rn
FROM (SELECT *, CASE WHEN hc = least(length(old_path), length(new_path)) THEN hc ELSE {_after_last_separator('substr(old_path, 1, hc)')} END AS h
FROM (SELECT *, {sql_shared_prefix('old_path', 'new_path')} AS hc FROM ({source}))))))"""


@query("rename_labels", sql_rename_parts(f"SELECT p_partkey AS id, {_OLD_NAME} AS old_path, {_NEW_NAME} AS new_path FROM part"))
def rename_labels(spark, sf):
    names = adapters.spread_table(spark, sf, "part", "p_partkey").select(
        F.col("p_partkey").alias("id"), F.expr(_OLD_NAME).alias("old_path"), F.expr(_NEW_NAME).alias("new_path"))
    return names.withColumn("_parts", paths.rename_struct(F.col("old_path"), F.col("new_path"))).select("id", "old_path", "new_path", "_parts.*")


def sql_human_size(v: str) -> str:
    cases = [f"WHEN abs({v}) < 1024 THEN format('{{:,.0f}} B', {v}::DOUBLE)"]
    for power, unit in enumerate(labels.SIZE_UNITS[1:-1], start=1):
        cases.append(f"WHEN abs({v}::DOUBLE / {1024 ** power}::DOUBLE) < 1024 THEN format('{{:,.1f}} {unit}', {v}::DOUBLE / {1024 ** power}::DOUBLE)")
    return "CASE " + " ".join(cases) + f" ELSE format('{{:,.1f}} PB', {v}::DOUBLE / {1024 ** 5}::DOUBLE) END"


@query("size_labels", f"""SELECT id, size_bytes, {sql_human_size('size_bytes')} AS size_label, CASE WHEN delta > 0 THEN '+' || delta ELSE CAST(delta AS VARCHAR) END AS delta_label
FROM (SELECT o_orderkey AS id, CAST(power(7, o_orderkey % 19) AS BIGINT) + o_orderkey AS size_bytes, o_orderkey % 5 - 2 AS delta FROM orders)""")
def size_labels(spark, sf):
    key = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        key.alias("id"), (F.pow(F.lit(7), key % 19).cast("bigint") + key).alias("size_bytes"), (key % 5 - 2).alias("delta"))
    return o.select("id", "size_bytes", labels.human_size(F.col("size_bytes")).alias("size_label"),
                    labels.signed(F.col("delta")).alias("delta_label"))


@query("age_buckets", """
SELECT event_id, CASE WHEN s < 60 THEN 'just now'
  WHEN s < 3600 THEN (s // 60) || CASE WHEN s // 60 = 1 THEN ' minute ago' ELSE ' minutes ago' END
  WHEN s < 86400 THEN (s // 3600) || CASE WHEN s // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END
  WHEN s < 172800 THEN 'yesterday' WHEN s < 14 * 86400 THEN (s // 86400) || ' days ago'
  WHEN s < 60 * 86400 THEN (s // 604800) || CASE WHEN s // 604800 = 1 THEN ' week ago' ELSE ' weeks ago' END
  ELSE strftime(ts, '%Y-%m-%d') END AS age
FROM (SELECT event_id, ts, CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)""")
def age_buckets(spark, sf):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", labels.age_label(F.col("ts"), as_of).alias("age"))


@query("recent_arrivals", """
SELECT event_id, ts, kind FROM (SELECT event_id, ts, event_type AS kind FROM events)
WHERE ts >= TIMESTAMP '2024-01-30 00:00:00'""")
def recent_arrivals(spark, sf):
    from ..operators.arrivals import recent

    events = table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("kind"))
    return recent(events, "ts", "2024-01-31 00:00:00", ArrivalOptions().startup_hours * 3600)


@query("whitespace_key", f"SELECT doc_id, sha256({sql_whitespace_key('text')}) AS key FROM documents")
def whitespace_key(spark, sf):
    return spread(spark, sf, "documents", "doc_id").select("doc_id", F.sha2(text.whitespace_key(F.col("text")), 256).alias("key"))


@query("path_parts", f"""SELECT page_id, path, {sql_dirname('path')} AS folder, {sql_basename('path')} AS name,
  CAST(length(path) - length(replace(path, '/', '')) AS INTEGER) AS depth, {sql_extension('path')} AS ext
FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)""")
def path_parts(spark, sf):
    path = F.col("path")
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path")).select(
        "page_id", "path", paths.dirname(path).alias("folder"), paths.basename(path).alias("name"),
        paths.depth(path).alias("depth"), paths.extension(path).alias("ext"))


@query("top_level_entries", f"""
SELECT artifact, seq, entry, CAST(row_number() OVER (PARTITION BY artifact, seq ORDER BY first_at, entry) AS BIGINT) AS position
FROM (SELECT artifact, seq, string_split(path, '/')[1] AS entry, min(doc_id) AS first_at FROM ({FILES}) GROUP BY ALL)""")
def top_level_entries(spark, sf):
    from ..sources.archives import top_level

    files = adapters.snapshot_files(spark, sf).select("artifact", "seq", "path", F.col("doc_id").alias("position"))
    return top_level(files)
