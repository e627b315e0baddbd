"""Bindings of the supplied star-schema tables to the snapshot data model.

Each adapter is a DataFrame over a parquet table; the ``*_SQL`` text beside it is
the same relation for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *key: str) -> DataFrame:
    """A table whose rows cost much work each, over at least one task per core.

    A single-file input scans in one task; only then are rows redistributed. An input
    with as many splits as there are cores is left alone: no shuffle at scale.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *key)


def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a file tree per document source.

    The second version drops and adds files, moves some, appends a line to some,
    doubles the spaces of some, edits the middle of some and marks some executable. Two
    files are large: an edited one over 2 MB, and one over 512 KB that is moved and edited.
    """
    docs = spread_table(spark, sf_dir, "documents", "doc_id")
    d, seq = F.col("doc_id"), F.col("seq")
    root = F.when(F.col("lang") == "en", F.lit("src/")).otherwise(F.concat(F.lit("vendor/"), F.col("lang"), F.lit("/")))
    path = F.concat(
        root,
        F.when((seq == 2) & (d % 17 == 0), F.lit("moved/")).otherwise(F.lit("")),
        F.lit("d"), (d % 4).cast("string"), F.lit("/"), d.cast("string"), F.lit(".txt"),
    )
    size = F.when(d == 70, 2_200_000).when(d == 85, 600_000)
    whole = F.when(size.isNotNull(), F.repeat(F.concat("text", F.lit("\n")), (F.lit(1) + F.floor(size / (F.length("text") + 1))).cast("int"))).otherwise(F.col("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    content = (
        F.when(seq == 1, whole)
        .when(d % 5 == 0, F.concat(whole, F.lit("\nTAIL = "), d.cast("string")))
        .when(d % 19 == 0, F.replace(F.col("text"), F.lit(" "), F.lit("  ")))
        .when(d % 7 == 3, F.concat(F.substring(F.col("text"), F.lit(1), half), F.lit(" edited "), F.substring(F.col("text"), half + 1, F.length("text"))))
        .otherwise(F.col("text"))
    )
    return (
        docs.select("doc_id", "source", "lang", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
        .where(((seq == 1) & (d % 11 != 0)) | ((seq == 2) & (d % 13 != 0)))
        .select(
            F.col("source").alias("artifact"), "seq", path.alias("path"), content.alias("content"),
            F.when((seq == 2) & (d % 29 == 0), 493).otherwise(420).alias("mode"), "doc_id",
        )
    )


SNAPSHOT_FILES_SQL = """
SELECT source AS artifact, CAST(seq AS INTEGER) AS seq,
  (CASE WHEN lang = 'en' THEN 'src/' ELSE 'vendor/' || lang || '/' END)
  || (CASE WHEN seq = 2 AND doc_id % 17 = 0 THEN 'moved/' ELSE '' END)
  || 'd' || (doc_id % 4) || '/' || doc_id || '.txt' AS path,
  CASE WHEN seq = 1 THEN whole
       WHEN doc_id % 5 = 0 THEN whole || chr(10) || 'TAIL = ' || doc_id
       WHEN doc_id % 19 = 0 THEN replace(text, ' ', '  ')
       WHEN doc_id % 7 = 3 THEN left(text, length(text) // 2) || ' edited ' || substr(text, length(text) // 2 + 1)
       ELSE text END AS content,
  CAST(CASE WHEN seq = 2 AND doc_id % 29 = 0 THEN 493 ELSE 420 END AS INTEGER) AS mode,
  doc_id
FROM (SELECT *, CASE doc_id WHEN 70 THEN repeat(text || chr(10), CAST(1 + 2200000 // (length(text) + 1) AS BIGINT))
  WHEN 85 THEN repeat(text || chr(10), CAST(1 + 600000 // (length(text) + 1) AS BIGINT)) ELSE text END AS whole FROM documents), (VALUES (1), (2)) AS s(seq)
WHERE (seq = 1 AND doc_id % 11 <> 0) OR (seq = 2 AND doc_id % 13 <> 0)
"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals from events: who, when, which archive bytes, which tree."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        "event_id", "ts", F.col("user_id").alias("artifact"), F.col("event_type").alias("kind"),
        F.concat_ws("|", "event_type", k, F.floor("value").cast("string")).alias("archive_key"),
        k.alias("tree_key"), "value",
    )


ARRIVALS_SQL = """
SELECT event_id, ts, user_id AS artifact, event_type AS kind,
  event_type || '|' || (props::JSON->>'$.k') || '|' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS archive_key,
  (props::JSON->>'$.k') AS tree_key, value
FROM events
"""


def fact_sets(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """One version of a keyed fact set from orders (side 'old' or 'new').

    Order lines play two roles: a declared row always, an installed row for even keys.
    """
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    base = o.where(key % (11 if side == "old" else 13) != 0)
    version = F.col("o_orderpriority")
    if side == "new":
        version = F.when(key % 5 == 0, F.concat(F.lit("new "), version)).otherwise(version)
    version = F.when(key % 7 == 0, F.lit(None)).otherwise(version)
    return base.select(
        F.col("o_custkey").alias("artifact"), F.col("o_orderstatus").alias("manager"),
        F.concat(F.when(key % 3 == 0, F.lit("Pkg-")).otherwise(F.lit("pkg-")), key.cast("string")).alias("name"),
        version.alias("version"),
        F.explode(F.when(key % 2 == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("is_declared"),
    )


def fact_sets_sql(side: str) -> str:
    modulus, changed = (11, "o_orderpriority") if side == "old" else (
        13, "CASE WHEN o_orderkey % 5 = 0 THEN 'new ' || o_orderpriority ELSE o_orderpriority END")
    return f"""
SELECT o_custkey AS artifact, o_orderstatus AS manager,
  (CASE WHEN o_orderkey % 3 = 0 THEN 'Pkg-' ELSE 'pkg-' END) || o_orderkey AS name,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {changed} END AS version, d.is_declared
FROM orders, (VALUES (true), (false)) AS d(is_declared)
WHERE o_orderkey % {modulus} <> 0 AND (d.is_declared OR o_orderkey % 2 = 0)
"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as histories: one artifact per conversation, one version per turn."""
    return spread_table(spark, sf_dir, "conversations", "conv_id", "turn").select(
        F.col("conv_id").alias("artifact"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")
    )


TURNS_SQL = "SELECT conv_id AS artifact, turn AS seq, role, text AS content FROM conversations"


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files written from the part table: a brand is an artifact, a part a file.

    Gives every pattern catalogue something to find, growing with the table.
    """
    p = spread_table(spark, sf_dir, "part", "p_partkey")
    key = F.col("p_partkey")
    ident = F.regexp_replace("p_name", "[^A-Za-z0-9]+", "_")
    upper = F.upper(ident)
    kind = (key % 6).cast("int")
    path = (
        F.when(kind == 0, F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/m"), key, F.lit(".py")))
        .when(kind == 1, F.concat(F.lit("m"), key, F.lit("/index.js")))
        .when(kind == 2, F.concat(F.lit("web/m"), key, F.lit(".ts")))
        .when(kind == 3, F.concat(F.lit("java/M"), key, F.lit(".java")))
        .when(kind == 4, F.concat(F.lit("m"), key, F.lit("/lambda_function.py")))
        .otherwise(F.concat(F.lit("node_modules/m"), key, F.lit("/index.js")))
    )
    content = (
        F.when(kind == 0, F.concat(
            F.lit("import os, boto3\nNAME = os.environ[\""), upper, F.lit("\"]\nREGION = os.getenv('AWS_REGION')\n"),
            F.lit("db = boto3.client('dynamodb')\ndef "), ident, F.lit("(event, context):\n    return NAME\n")))
        .when(kind == 1, F.concat(
            F.lit("const c = require('@aws-sdk/client-sfn');\nconst a = process.env."), upper,
            F.lit(";\nexports.handler = async (e) => a;\nexports."), ident, F.lit(" = () => 1;\n")))
        .when(kind == 2, F.concat(
            F.lit("const s = new AWS.S3();\nconst b = process.env['"), upper, F.lit("'];\nexport const "), ident,
            F.lit(" = 1;\n")))
        .when(kind == 3, F.concat(
            F.lit("import software.amazon.awssdk.services.sqs;\nclass M implements RequestHandler {\n String v = System.getenv(\""),
            upper, F.lit("\");\n}\n")))
        .when(kind == 4, F.concat(
            F.lit("import os\n# sized "), F.col("p_size").cast("string"), F.lit("\nTABLE = os.environ.get(\"TABLE_"), upper,
            F.lit("\")\ndef lambda_handler(event, context):\n    return TABLE\n\ndef _"), ident,
            F.lit("(a, b):\n    return os.environ.get(\"PATH\"), os.environ.get(\"TABLE_"), upper, F.lit("\")\n")))
        .otherwise(F.concat(F.lit("const x = process.env.VENDORED_"), upper, F.lit(";\n")))
    )
    return p.select(
        F.col("p_brand").alias("artifact"), F.lit(1).alias("seq"), path.alias("path"), content.alias("content"),
        F.lit(420).alias("mode"),
    )


CODE_FILES_SQL = """
SELECT p_brand AS artifact, 1 AS seq,
  CASE p_partkey % 6
    WHEN 0 THEN 'src/' || lower(p_type) || '/m' || p_partkey || '.py'
    WHEN 1 THEN 'm' || p_partkey || '/index.js'
    WHEN 2 THEN 'web/m' || p_partkey || '.ts'
    WHEN 3 THEN 'java/M' || p_partkey || '.java'
    WHEN 4 THEN 'm' || p_partkey || '/lambda_function.py'
    ELSE 'node_modules/m' || p_partkey || '/index.js' END AS path,
  CASE p_partkey % 6
    WHEN 0 THEN 'import os, boto3' || chr(10) || 'NAME = os.environ["' || upper(ident) || '"]' || chr(10)
      || 'REGION = os.getenv(''AWS_REGION'')' || chr(10) || 'db = boto3.client(''dynamodb'')' || chr(10)
      || 'def ' || ident || '(event, context):' || chr(10) || '    return NAME' || chr(10)
    WHEN 1 THEN 'const c = require(''@aws-sdk/client-sfn'');' || chr(10) || 'const a = process.env.' || upper(ident)
      || ';' || chr(10) || 'exports.handler = async (e) => a;' || chr(10) || 'exports.' || ident || ' = () => 1;' || chr(10)
    WHEN 2 THEN 'const s = new AWS.S3();' || chr(10) || 'const b = process.env[''' || upper(ident) || '''];' || chr(10)
      || 'export const ' || ident || ' = 1;' || chr(10)
    WHEN 3 THEN 'import software.amazon.awssdk.services.sqs;' || chr(10) || 'class M implements RequestHandler {' || chr(10)
      || ' String v = System.getenv("' || upper(ident) || '");' || chr(10) || '}' || chr(10)
    WHEN 4 THEN 'import os' || chr(10) || '# sized ' || p_size || chr(10) || 'TABLE = os.environ.get("TABLE_' || upper(ident)
      || '")' || chr(10) || 'def lambda_handler(event, context):' || chr(10) || '    return TABLE' || chr(10) || chr(10)
      || 'def _' || ident || '(a, b):' || chr(10) || '    return os.environ.get("PATH"), os.environ.get("TABLE_' || upper(ident)
      || '")' || chr(10)
    ELSE 'const x = process.env.VENDORED_' || upper(ident) || ';' || chr(10) END AS content,
  420 AS mode
FROM (SELECT *, regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') AS ident FROM part)
"""


# One manifest of each kind in turn from the part table: its folder and name, and its text, in
# which {n} is the part's package name and {v} its version. Two packages, {n}-a and {n}-b, are in each but METADATA.
MANIFESTS = (
    ("{n}/requirements.txt", "# pinned\n{n}-a=={v}\n-r base.txt\n{n}-b[extra] >= {v} ; python_version > '3'\n# {k}\n"),
    ("{n}/package.json", '{"name": "{n}", "dependencies": {"{n}-a": "{v}"}, "devDependencies": {"{n}-b": "{v}"}}\n'),
    ("{n}/package-lock.json", '{"packages": {"": {"name": "{n}"}, "node_modules/{n}-a": {"version": "{v}"}, "node_modules/x/node_modules/{n}-b": {"version": "{v}"}}}\n'),
    ("{n}/old/package-lock.json", '{"dependencies": {"{n}-a": {"version": "{v}"}, "{n}-b": {"version": "{v}"}}}\n'),
    ("lib/{n}.dist-info/METADATA", "Metadata-Version: 2.1\nName: {n}-a\nVersion: {v}\n\nName: not-this\n"),
    ("{n}/go.mod", "module m\n\nrequire (\n\texample.com/{n}-a v{v}\n)\nrequire example.com/{n}-b v{v}\n"),
    ("{n}/pom.xml", "<project><dependency><groupId>g</groupId><artifactId>{n}-a</artifactId><version>{v}</version></dependency>\n<dependency><artifactId>{n}-b</artifactId></dependency></project>\n"),
    ("{n}/Gemfile.lock", "GEM\n  specs:\n    {n}-a ({v})\n      inner (1)\n    {n}-b ({v})\n"),
    ("{n}/pyproject.toml", '[project]\nname = "x"\ndependencies = ["{n}-a=={v}"]\n\n[tool.poetry.dependencies]\npython = "^3"\n{n}-b = {version = "{v}"}\n'),
    ("{n}/yarn.lock", '{n}-a@^1:\n  version "{v}"\n\n"{n}-b@^2":\n  version "{v}"\n'),
)


def _manifest_text(template: str, quote, join: str, values: dict[str, str]) -> str:
    """A template as an SQL concatenation; ``quote`` writes a text literal."""
    import re

    parts = [p for p in re.split(r"(\{[nvk]\})", template) if p]
    return join.join(values[p] if p in values else quote(p) for p in parts)


def _manifest_case(which: int, quote, values: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {i} THEN concat({_manifest_text(m[which], quote, ', ', values)})" for i, m in enumerate(MANIFESTS))
    return f"CASE p_partkey % {len(MANIFESTS)} {cases} END"


_KEY_OF = "concat('AKIA', upper(substr({sha}, 1, 16)))"
_NAME, _VERSION = "concat('n', CAST(p_partkey AS {t}))", "concat(CAST(p_size AS {t}), '.', CAST(p_partkey % 7 AS {t}))"


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package manifest of some kind per part; a brand is an artifact. Requirement files leak a key."""
    def quote(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"

    values = {"{n}": _NAME.format(t="STRING"), "{v}": _VERSION.format(t="STRING"), "{k}": _KEY_OF.format(sha="sha2(CAST(p_partkey AS STRING), 256)")}
    return spread_table(spark, sf_dir, "part", "p_partkey").select(
        F.col("p_brand").alias("artifact"), F.lit(1).alias("seq"), F.expr(_manifest_case(0, quote, values)).alias("path"),
        F.expr(_manifest_case(1, quote, values)).alias("content"), F.lit(420).alias("mode"))


def _manifest_files_sql() -> str:
    def quote(text: str) -> str:
        return "concat('" + text.replace("'", "''").replace("\n", "', chr(10), '").replace("\t", "', chr(9), '") + "')"

    values = {"{n}": _NAME.format(t="VARCHAR"), "{v}": _VERSION.format(t="VARCHAR"), "{k}": _KEY_OF.format(sha="sha256(CAST(p_partkey AS VARCHAR))")}
    return (f"SELECT p_brand AS artifact, 1 AS seq, {_manifest_case(0, quote, values)} AS path, {_manifest_case(1, quote, values)} AS content, 420 AS mode FROM part")


MANIFEST_FILES_SQL = _manifest_files_sql()
# What those manifests say: manager, whether declared, and the names and versions of both packages, by kind.
MANIFEST_FACTS_SQL = f"""
SELECT artifact, 1 AS seq, manager, name, version, source, is_declared FROM (
  SELECT p_brand AS artifact, k, n, v, s AS source, unnest(CASE WHEN k = 4 THEN ['a'] ELSE ['a', 'b'] END) AS x,
    CASE k WHEN 0 THEN 'pip' WHEN 4 THEN 'pip' WHEN 8 THEN 'pip' WHEN 5 THEN 'go' WHEN 6 THEN 'maven' WHEN 7 THEN 'gem' ELSE 'npm' END AS manager, k IN (0, 1, 5, 6, 8) AS is_declared,
    CASE k WHEN 5 THEN 'example.com/' || n || '-' || x WHEN 6 THEN CASE WHEN x = 'a' THEN 'g:' ELSE '' END || n || '-' || x ELSE n || '-' || x END AS name,
    CASE WHEN k = 5 THEN 'v' || v WHEN k = 6 AND x = 'b' THEN NULL ELSE v END AS version
  FROM (SELECT *, p_partkey % {len(MANIFESTS)} AS k, 'n' || p_partkey AS n, p_size || '.' || (p_partkey % 7) AS v, {_manifest_case(0, lambda t: "'" + t + "'", {"{n}": _NAME.format(t="VARCHAR")})} AS s FROM part))"""
