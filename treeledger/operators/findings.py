"""Credential findings, redaction, and high-entropy runs.

The rule set is this library's own; only the kinds and the way a finding is shown
are given.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from .extract import numbered_lines


@dataclass(frozen=True)
class Rule:
    """A pattern in three parts: what stands before the secret, the secret, what follows.

    ``hints`` are literals of which every match holds one (compared in lower case
    when ``fold``): a text without them is never given to the regular expression.
    """

    kind: str
    severity: str
    before: str
    secret: str
    after: str = ""
    hints: tuple[str, ...] = ()
    fold: bool = False
    placeholders: bool = False
    show_whole: bool = False

    @property
    def regex(self) -> str:
        return f"({self.before})({self.secret})({self.after})"

    def possible(self, column: Column) -> Column:
        """Whether a match can be there at all, by plain substring search."""
        subject = F.lower(column) if self.fold else column
        return reduce(or_, [F.contains(subject, F.lit(h)) for h in self.hints]) if self.hints else F.lit(True)


RULES = (
    Rule("aws-access-key-id", "high", r"\b", r"(?:AKIA|ASIA)[0-9A-Z]{16}", r"\b", ("AKIA", "ASIA")),
    Rule("stripe-key", "high", r"\b", r"[sr]k_live_[0-9A-Za-z]{16,}", r"\b", ("k_live_",)),
    Rule("github-token", "high", r"\b", r"gh[pousr]_[0-9A-Za-z]{36,}", r"\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("private-key", "high", r"-----BEGIN ", r"(?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY", r"-----", ("PRIVATE KEY-----",)),
    Rule("hardcoded-credential", "medium",
         r"(?i:passwd|password|pwd|secret|token|api_?key|access_?key)['\"]?[ \t]*[:=][ \t]*['\"]", r"[^'\" \t\r\n]{8,}", r"['\"]",
         ("passw", "pwd", "secret", "token", "apikey", "api_key", "accesskey", "access_key"), fold=True, placeholders=True),
    Rule("debug-flag", "low", r"\b", r"(?i:debug)[ \t]*=[ \t]*(?i:true)", r"\b", ("debug",), fold=True, show_whole=True),
)
PLACEHOLDER = (r"(?i)^(?:.*change_?me.*|.*example.*|.*placeholder.*|your[_-].*|x{4,}|\*{4,}|<.*>|\$\{.*\}|\{\{.*\}\}|"
               r"none|null|true|false|test|todo|dummy|sample.*|os\.environ.*|process\.env.*|password|secret|redacted.*|«.*)$")
TOKENISH = r"[A-Za-z0-9+/_=-]{32,}"
TOKEN_MARK = "«redacted high-entropy string»"
SEVERITY_ORDER = ("high", "medium", "low")


def redacted_detail(secret: Column) -> Column:
    """``AKIA…LE (20 chars)``."""
    return F.concat(F.substring(secret, 1, 4), F.lit("…"), F.substring(secret, -2, 2), F.lit(" ("), F.length(secret).cast("string"), F.lit(" chars)"))


def _finding_of(rule: Rule):
    def make(value: Column) -> Column:
        detail = value if rule.show_whole else redacted_detail(value)
        return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.severity).alias("severity"), detail.alias("detail"))

    return make


def findings(files: DataFrame, keys: tuple[str, ...] = ("artifact", "seq", "path"), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per credential-shaped value: kind, severity, line, and a detail that hides it."""
    def may_hold(column: Column) -> Column:
        return reduce(or_, [r.possible(column) for r in rules])

    lines = numbered_lines(files, list(keys), may_hold(F.col("content"))).where(may_hold(F.col("line")))
    parts = []
    for rule in rules:
        values = F.regexp_extract_all(F.col("line"), F.lit(rule.regex), F.lit(2))
        if rule.placeholders:
            values = F.filter(values, lambda v: ~v.rlike(PLACEHOLDER))
        parts.append(F.transform(values, _finding_of(rule)))
    hits = lines.select(*keys, "line_no", F.explode(F.concat(*parts)).alias("f"))
    vendored = paths.is_vendored(F.col("path")) if "path" in keys else F.lit(False)
    return hits.select(*keys, "f.kind", "f.severity", "line_no", "f.detail", vendored.alias("is_vendor"))


def severity_rank(severity: Column) -> Column:
    """1 for the worst; unknown severities come after the known ones."""
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), severity)
    return F.when(place > 0, place).otherwise(len(SEVERITY_ORDER) + 1).cast("int")


def is_random_token(token: Column) -> Column:
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (F.round(text.shannon_entropy(token), 6) >= 4.0)


def redact(rows: DataFrame, column: str, out: str = "redacted", count: str = "redactions", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Replace the secret part of every rule match, then random-looking runs; count both.

    Rules do not cross lines, so a whole text gives what its lines give. Runs are
    judged one by one: the text is cut at them, each is kept or replaced, and the
    pieces are put back, so a run inside a longer one is never touched.
    """
    work = rows.withColumn(out, F.col(column)).withColumn(count, F.lit(0))
    for rule in rules:
        text_now = F.col(out)
        work = work.withColumn("_may", rule.possible(text_now))
        work = work.withColumn(count, F.col(count) + F.when(F.col("_may"), F.regexp_count(text_now, F.lit(rule.regex))).otherwise(0)).withColumn(
            out, F.when(F.col("_may"), F.regexp_replace(text_now, rule.regex, f"$1«redacted {rule.kind}»$3")).otherwise(text_now))
    runs = F.regexp_extract_all(F.col(out), F.lit(TOKENISH), F.lit(0))
    work = work.withColumn("_runs", F.transform(runs, lambda t: F.struct(t.alias("t"), is_random_token(t).alias("r"))))
    between = F.split(F.col(out), TOKENISH, -1)
    kept = F.transform(F.col("_runs"), lambda e: F.when(e["r"], F.lit(TOKEN_MARK)).otherwise(e["t"]))
    rebuilt = F.array_join(F.zip_with(between, kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    flagged = F.size(F.filter(F.col("_runs"), lambda e: e["r"]))
    work = work.withColumn(count, (F.col(count) + flagged).cast("bigint"))
    return work.withColumn(out, F.when(flagged > 0, rebuilt).otherwise(F.col(out))).drop("_runs", "_may")


def tokens(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Distinct long runs per key with their entropy and whether they look random."""
    found = rows.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(TOKENISH), F.lit(0)))).alias("token"))
    return found.withColumn("entropy", F.round(text.shannon_entropy(F.col("token")), 6)).withColumn("is_random", is_random_token(F.col("token")))
