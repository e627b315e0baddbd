"""Declared and installed dependencies read from package manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import lines_of
from .facts import VERSION
from .sets import prefer_non_null

DEP = "struct<name:string,version:string>"
# Fixed value: a requirement line's name, extras, operator and version.
REQUIREMENT = r"^\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*(==|>=|<=|~=|!=|>|<|===)?\s*([^\s;#]+)?"
# Manifest file names.
REQUIREMENT_FILES = ("requirements.txt", "requirements-prod.txt", "requirements_prod.txt")


def _dep(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version")).cast(DEP)


def _blank(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _requirement(line: Column) -> Column:
    operator = F.regexp_extract(line, REQUIREMENT, 2)
    version = F.when(operator != "", _blank(F.regexp_extract(line, REQUIREMENT, 3)))
    return _dep(_blank(F.regexp_extract(line, REQUIREMENT, 1)), version)


def requirements(content: Column) -> Column:
    """pip requirement lines: comments and flags out, urls and ``name @ url`` in."""
    lines = F.transform(lines_of(content), lambda raw: F.trim(F.regexp_replace(F.regexp_replace(raw, "#.*$", ""), r"[\t\r]", " ")))
    kept = F.filter(lines, lambda s: (s != "") & ~s.startswith("-"))

    def one(line: Column) -> Column:
        tail = F.substring_index(F.regexp_replace(F.regexp_replace(line, r"\?.*$", ""), "/+$", ""), "/", -1)
        return (
            F.when(line.rlike("^(git\\+|https?://)"), _dep(F.coalesce(_blank(tail), line), F.lit(None)))
            .when(F.contains(line, F.lit(" @ ")), _dep(F.trim(F.substring_index(line, " @ ", 1)), F.trim(F.regexp_extract(line, "^.*? @ (.*)$", 1))))
            .otherwise(_requirement(line))
        )

    return F.filter(F.transform(kept, one), lambda d: d["name"].isNotNull())


def pyproject(content: Column) -> Column:
    """The [project] dependency list and the Poetry table."""
    project = F.regexp_extract(content, r"(?ms)^\[project\][ \t]*$(.*?)(?=^\[|\z)", 1)
    listed = F.regexp_extract(project, r"(?s)\bdependencies\s*=\s*\[(.*?)\]\s*(?:\n|\z)", 1)
    specs = F.transform(F.regexp_extract_all(listed, F.lit(r"[\"']([^\"'\n]+)[\"']"), F.lit(1)), _requirement)
    table = F.regexp_extract(content, r"(?ms)^\[tool\.poetry\.dependencies\][ \t]*$(.*?)(?=^\[|\z)", 1)
    entries = F.filter(F.split(table, "\n"), lambda s: s.rlike(r"^\s*[\"']?[A-Za-z0-9._-]+[\"']?\s*="))

    def one(line: Column) -> Column:
        name = F.regexp_extract(line, r"^\s*[\"']?([A-Za-z0-9._-]+)[\"']?\s*=", 1)
        plain = F.regexp_extract(line, r"=\s*[\"']([^\"']*)[\"']\s*(?:#.*)?$", 1)
        inner = F.regexp_extract(line, r"=\s*\{.*?version\s*=\s*[\"']([^\"']*)[\"']", 1)
        return _dep(name, F.when(line.rlike(r"=\s*\{"), _blank(inner)).otherwise(_blank(plain)))

    poetry = F.filter(F.transform(entries, one), lambda d: F.lower(d["name"]) != "python")
    return F.concat(F.filter(specs, lambda d: d["name"].isNotNull()), poetry)


def _text_of(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _entries(doc: Column, at: str) -> Column:
    """Entries of one JSON object as an array; none when it is not an object."""
    got = F.map_entries(F.try_variant_get(doc, at, "map<string,variant>"))
    return F.coalesce(got, F.array().cast("array<struct<key:string,value:variant>>"))


def package_json(content: Column) -> Column:
    doc = F.try_parse_json(content)
    sections = ("$.dependencies", "$.devDependencies", "$.optionalDependencies")
    return F.concat(*[F.transform(_entries(doc, s), lambda e: _dep(e["key"], _text_of(e["value"]))) for s in sections])


def installed_package(content: Column) -> Column:
    """A vendored package.json: its own name and version."""
    doc = F.try_parse_json(content)
    name, version = (_text_of(F.try_variant_get(doc, p, "variant")) for p in ("$.name", "$.version"))
    return F.filter(F.array(_dep(name, version)), lambda d: d["name"].isNotNull())


def package_lock(content: Column) -> Column:
    """npm lock files: the flat ``packages`` layout, else the older ``dependencies`` one."""
    doc = F.try_parse_json(content)
    packages = F.filter(_entries(doc, "$.packages"), lambda e: e["key"] != "")
    flat = F.transform(packages, lambda e: _dep(
        F.coalesce(_text_of(F.try_variant_get(e["value"], "$.name", "variant")), F.element_at(F.split(e["key"], "node_modules/"), -1)),
        _text_of(F.try_variant_get(e["value"], "$.version", "variant"))))
    older = F.transform(_entries(doc, "$.dependencies"), lambda e: _dep(e["key"], _text_of(F.try_variant_get(e["value"], "$.version", "variant"))))
    is_flat = F.try_variant_get(doc, "$.packages", "map<string,variant>").isNotNull()
    return F.when(is_flat, F.filter(flat, lambda d: d["name"] != "")).otherwise(older)


def yarn_lock(content: Column) -> Column:
    blocks = F.filter(F.split(content, r"\n[ \t]*\n"), lambda b: b.rlike(r"(?m)^\"?[^@\s\"][^@\s\"]*@[^\n:]*:\s*$") & b.rlike(r"\n\s+version\s+\""))
    return F.transform(blocks, lambda b: _dep(
        F.regexp_extract(b, r"(?m)^\"?([^@\s\"][^@\s\"]*)@[^\n:]*:\s*$", 1), F.regexp_extract(b, r"\n\s+version\s+\"([^\"]+)\"", 1)))


def go_mod(content: Column) -> Column:
    line = r"^\s*([^\s/]+\S*)\s+(v\S+)"
    blocks = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(r"(?s)require\s*\(([^)]*)\)"), F.lit(1)), lambda b: F.split(b, "\n")))
    grouped = F.transform(F.filter(blocks, lambda s: s.rlike(line)), lambda s: _dep(F.regexp_extract(s, line, 1), F.regexp_extract(s, line, 2)))
    single = r"^\s*require\s+([^\s(]+)\s+([^\s(]+)"
    alone = F.filter(F.split(content, "\n"), lambda s: s.rlike(single) & ~F.contains(s, F.lit("(")))
    return F.concat(grouped, F.transform(alone, lambda s: _dep(F.regexp_extract(s, single, 1), F.regexp_extract(s, single, 2))))


def pom(content: Column) -> Column:
    def tag(block: Column, name: str) -> Column:
        return _blank(F.trim(F.regexp_extract(block, f"(?s)<{name}>\\s*(.*?)\\s*</{name}>", 1)))

    blocks = F.regexp_extract_all(content, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    named = F.filter(blocks, lambda b: tag(b, "artifactId").isNotNull())
    return F.transform(named, lambda b: _dep(F.concat_ws(":", tag(b, "groupId"), tag(b, "artifactId")), tag(b, "version")))


def gemfile_lock(content: Column) -> Column:
    line = r"^ {4}([a-zA-Z0-9_-]+)\s+\(([^)]+)\)"
    hits = F.filter(F.split(content, "\n"), lambda s: s.rlike(line))
    return F.transform(hits, lambda s: _dep(F.regexp_extract(s, line, 1), F.regexp_extract(s, line, 2)))


def metadata(content: Column) -> Column:
    """``Name:`` and ``Version:`` of a header that ends at the first blank line."""
    header = F.split(content, r"\n[ \t\r]*\n").getItem(0)
    name, version = (_blank(F.trim(F.regexp_extract(header, f"(?m)^{field}:([^\\n]*)$", 1))) for field in ("Name", "Version"))
    return F.filter(F.array(_dep(name, version)), lambda d: d["name"].isNotNull())


def dependencies(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Dependencies of each version, one per (manager, lower name, is_declared).

    Each manifest is parsed where it is read; only the parsed rows are shuffled. With
    ``max_bytes`` larger manifests are left out.
    """
    path, content = F.col("path"), F.col("content")
    name, parent = F.lower(paths.basename(path)), F.lower(paths.basename(paths.dirname(path)))
    in_node = F.contains(path, F.lit("node_modules/"))
    tail = F.substring_index(path, "node_modules/", -1)
    direct = paths.depth(tail) <= F.when(tail.startswith("@"), 2).otherwise(1)
    own = ~paths.is_vendored(path)
    if max_bytes is not None:
        own = own & (F.octet_length(content) <= max_bytes)
    header = ((name == "metadata") & parent.endswith(".dist-info")) | ((name == "pkg-info") & parent.endswith(".egg-info"))
    routes = [
        (header, "pip", False, metadata), ((name == "package.json") & in_node & direct, "npm", False, installed_package),
        (own & name.isin(*REQUIREMENT_FILES), "pip", True, requirements), (own & (name == "pyproject.toml"), "pip", True, pyproject),
        (own & (name == "package.json") & ~in_node, "npm", True, package_json), (own & (name == "package-lock.json"), "npm", False, package_lock),
        (own & (name == "yarn.lock"), "npm", False, yarn_lock), (own & (name == "go.mod"), "go", True, go_mod),
        (own & (name == "pom.xml"), "maven", True, pom), (own & (name == "gemfile.lock"), "gem", False, gemfile_lock),
    ]
    manager = declared = found = None
    for condition, system, is_declared, parse in routes:
        manager = F.when(condition, system) if manager is None else manager.when(condition, system)
        declared = F.when(condition, is_declared) if declared is None else declared.when(condition, is_declared)
        found = F.when(condition, parse(content)) if found is None else found.when(condition, parse(content))
    rows = files.select(*VERSION, "path", manager.alias("manager"), declared.alias("is_declared"), F.posexplode(found).alias("_at", "d")).select(
        *VERSION, "manager", F.col("d.name").alias("name"), F.col("d.version").alias("version"), F.col("path").alias("source"), "is_declared",
        F.struct("path", "_at").alias("position"))
    return prefer_non_null(rows, [*VERSION, "manager", F.lower("name").alias("_key"), "is_declared"], "version", "position", ["name", "version", "source"]).drop("_key")
