"""Column expressions over paths and names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import STRIP_PATTERNS, VENDOR_GLOBS
from .text import bound, shared_prefix

# File extension to language label.
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript",
    ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".kt": "kotlin", ".go": "go", ".rb": "ruby", ".rs": "rust",
    ".cs": "csharp", ".php": "php", ".sh": "shell", ".bash": "shell", ".ps1": "powershell",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".ini": "ini",
    ".cfg": "ini", ".xml": "xml", ".html": "html", ".css": "css", ".sql": "sql",
    ".md": "markdown", ".txt": "text", ".csv": "csv", ".env": "dotenv",
    ".jar": "binary", ".so": "binary", ".dll": "binary", ".dylib": "binary",
    ".pyc": "binary", ".zip": "binary", ".png": "binary", ".jpg": "binary",
    ".gz": "binary", ".whl": "binary", ".class": "binary",
}
# Names that carry a language without an extension.
BARE_NAMES = ("dockerfile", "makefile", "gemfile", "rakefile", "procfile")
# Languages that may turn into one another in a move.
LANGUAGE_FAMILY = {"javascript": "ecmascript", "typescript": "ecmascript"}
# Stems that say nothing about the artifact.
GENERIC_STEMS = (
    "code", "function", "lambda", "lambda_function", "deployment", "package",
    "archive", "download", "export", "backup", "source", "src", "app", "index",
    "handler", "main", "bundle", "dist", "build", "output",
)
# Device names that cannot name a folder on some systems.
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", "COM[1-9]", "LPT[1-9]")
# Letters folded to ASCII. Covers Latin-1, not all of NFKD.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
# Fixed value: the ref a source archive's directory ends in.
REF_PATTERN = (
    r"[-_](v?\d+\.\d+(?:\.\d+)?(?:[-.][0-9A-Za-z.]+)?|main|master|develop|trunk|[0-9a-f]{7,40})$"
)
# Fixed value: files whose contents are never quoted.
WITHHELD_PATTERN = (
    r"(?i)(?:^|/)(?:\.env(?:\.[^/]*)?|\.npmrc|\.pypirc|\.netrc|\.git-credentials|"
    r"id_(?:rsa|dsa|ecdsa|ed25519)(?:\.pub)?|[^/]*credentials[^/]*|"
    r"secrets?\.(?:json|ya?ml|toml|ini|txt|env)|[^/]*\.(?:pem|key|p12|pfx|jks|keystore|kdbx))$"
)


def literal_map(mapping: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in mapping.items()) + ")")


def dirname(path: Column) -> Column:
    """``a/b/c.py`` -> ``a/b``; a path without a slash -> ''."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column) -> Column:
    return (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("int")


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; a leading dot alone opens no suffix."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def language_label(path: Column) -> Column:
    ext = extension(path)
    name = F.lower(basename(path))
    return (
        F.when(ext != "", F.coalesce(F.element_at(literal_map(LANGUAGE_BY_EXTENSION), ext), F.substring(ext, F.lit(2), F.length(ext))))
        .when(name.isin(*BARE_NAMES), name)
        .otherwise(F.lit("text"))
    )


def glob_regex(globs: Iterable[str]) -> str:
    """One anchored alternation for a set of globs; ``*`` crosses slashes.

    ``x/**`` also matches ``x``; ``**/x`` also matches ``x`` at the root.
    """

    def body(glob: str) -> str:
        out, i = [], 0
        while i < len(glob):
            ch = glob[i]
            closing = glob.find("]", i + 2) if ch == "[" else -1
            if ch == "*":
                if not out or out[-1] != ".*":
                    out.append(".*")
            elif ch == "?":
                out.append(".")
            elif closing > 0:
                inner = glob[i + 1:closing]
                out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]")
                i = closing
            else:
                out.append(re.sub(r"([.^$+{}()|\[\]\\])", r"\\\1", ch))
            i += 1
        return "".join(out)

    parts: list[str] = []
    for glob in globs:
        forms = [body(glob)]
        if glob.endswith("/**"):
            forms.append(body(glob[:-3]))
        if glob.startswith("**/"):
            forms.append(body(glob[3:]))
        parts.extend(form for form in forms if form not in parts)
    return "(?s)^(?:" + "|".join(parts) + ")$"


def matches_any(path: Column, globs: Iterable[str]) -> Column:
    globs = tuple(globs)
    return path.rlike(glob_regex(globs)) if globs else F.lit(False)


def is_vendored(path: Column, globs: Iterable[str] = VENDOR_GLOBS) -> Column:
    return matches_any(path, globs)


def language_family(lang: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(LANGUAGE_FAMILY), lang), F.lit(""))


def pair_key(path: Column, lang: Column) -> Column:
    """The part of a name that survives a move: the file name, or stem + family."""
    family = language_family(lang)
    name = basename(path)
    bare = F.when(name.contains("."), F.regexp_replace(name, r"^(.*)\.[^.]*$", "$1")).otherwise(name)
    bare = F.when(bare == "", name).otherwise(bare)
    return F.when(family == "", F.concat(name, F.lit("|"))).otherwise(F.concat(bare, F.lit("|"), family))


def slugify(name: Column, fallback: str = "unnamed", longest: int | None = None) -> Column:
    """Folder-safe form of a name, cut to ``longest`` characters where given."""
    folded = F.regexp_replace(F.translate(name, ACCENTED, FOLDED), r"[^\x00-\x7F]", "")
    slug = F.regexp_replace(folded, r"[^A-Za-z0-9._-]+", "-")
    slug = F.regexp_replace(slug, r"^[-._]+|[-._]+$", "")
    slug = F.regexp_replace(slug, r"-{2,}", "-")
    device = "^(?:" + "|".join(RESERVED_NAMES) + ")$"

    def safe(slug: Column) -> Column:
        reserved = F.upper(F.substring_index(slug, ".", 1)).rlike(device)
        return F.when(reserved, F.concat(F.lit("_"), slug)).otherwise(slug)

    slug = bound(bound(slug, lambda s: F.when(s == "", F.lit(fallback)).otherwise(s)), safe)
    return slug if longest is None else F.substring(slug, 1, longest)


def clean_name(stem_column: Column, patterns: Iterable[str] = STRIP_PATTERNS, passes: int = 4) -> Column:
    """Strip download suffixes, stamps and hashes until nothing more comes off."""
    out = F.trim(stem_column)
    for _ in range(passes):
        for pattern in patterns:
            out = F.trim(F.regexp_replace(out, pattern, ""))
        tail = F.regexp_extract(out, r"[-_]([0-9a-f]{7,12})$", 1)
        short_commit = (tail != "") & tail.rlike("[0-9]")
        out = F.when(short_commit, F.trim(F.regexp_replace(out, r"[-_][0-9a-f]{7,12}$", ""))).otherwise(out)
        out = F.regexp_replace(out, r"^[ \-_.]+|[ \-_.]+$", "")
    return out


def looks_meaningless(candidate: Column) -> Column:
    return (
        (F.length(candidate) < 2)
        | F.lower(candidate).isin(*GENERIC_STEMS)
        | candidate.rlike("^[0-9a-fA-F]{8,}$")
        | candidate.rlike("^[0-9]+$")
        | ((F.length(candidate) > 24) & candidate.rlike("^[A-Za-z0-9+/=_-]{22,}$") & ~candidate.rlike("[-_]"))
    )


def ref_label(name: Column) -> Column:
    """Ref from a source archive's directory name; null when it carries none."""
    ref = F.regexp_extract(F.trim(name), REF_PATTERN, 1)
    return F.when(ref == "", F.lit(None)).when(ref.rlike("^[0-9]"), F.concat(F.lit("v"), ref)).otherwise(ref)


def module_name(path: Column) -> Column:
    """``a/b.py`` -> ``a.b``."""
    folder = dirname(path)
    return F.when(folder == "", stem(path)).otherwise(
        F.concat(F.replace(folder, F.lit("/"), F.lit(".")), F.lit("."), stem(path))
    )


def rename_struct(old: Column, new: Column) -> Column:
    """Split a rename into shared prefix, was, is now and shared suffix.

    Cuts fall just after a separator in front and just before the separator-led
    tail behind, so the middle is whole pieces of a name. Each step is computed once.
    """

    def upto_separator(shared: Column) -> Column:
        return F.length(F.regexp_extract(shared, r"^(.*[/\-_.])[^/\-_.]*$", 1))

    def shared_head(p: Column) -> Column:
        return F.struct(p["old"].alias("old"), p["new"].alias("new"), shared_prefix(p["old"], p["new"]).alias("chars"))

    def head(p: Column) -> Column:
        shorter = F.least(F.length(p["old"]), F.length(p["new"]))
        cut = F.when(p["chars"] == shorter, shorter).otherwise(upto_separator(F.substring(p["old"], F.lit(1), p["chars"])))
        return F.struct(p["old"].alias("old"), p["new"].alias("new"), cut.alias("head"))

    def rest(p: Column) -> Column:
        return F.struct(F.substring(p["old"], F.lit(1), p["head"]).alias("prefix"), *[
            F.substring(p[side], p["head"] + 1, F.length(p[side])).alias(side) for side in ("old", "new")])

    def tail(p: Column) -> Column:
        back = F.reverse(p["old"])
        cut = upto_separator(F.substring(back, F.lit(1), shared_prefix(back, F.reverse(p["new"]))))
        return F.struct(p["prefix"].alias("prefix"), p["old"].alias("old"), p["new"].alias("new"), cut.alias("tail"))

    def parts(p: Column) -> Column:
        kept = F.length(p["old"]) - p["tail"]
        return F.struct(
            p["prefix"].alias("prefix"), F.substring(p["old"], F.lit(1), kept).alias("was"),
            F.substring(p["new"], F.lit(1), F.length(p["new"]) - p["tail"]).alias("now"), F.substring(p["old"], kept + 1, F.length(p["old"])).alias("suffix"))

    out = F.struct(old.alias("old"), new.alias("new"))
    for step in (shared_head, head, rest, tail, parts):
        out = bound(out, step)
    return out


def rename_parts(old: Column, new: Column) -> dict[str, Column]:
    """The fields of ``rename_struct`` one by one."""
    whole = rename_struct(old, new)
    return {name: whole[name] for name in ("prefix", "was", "now", "suffix")}


def rename_folder(old: Column, new: Column) -> Column:
    """The folder a rename hangs under: the last whole folder both sides share."""
    return dirname(rename_parts(old, new)["prefix"])
