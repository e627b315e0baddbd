"""Preparing changes for a reader: budgets, briefs, answers, citations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..options import AnswerOptions, ReviewOptions
from .durable import durable
from .ordered import ordered, top_per_group

# Change kinds and levels an answer may use, and its text limits.
CHANGE_KINDS = ("feature", "fix", "behaviour", "refactor", "dependency", "config", "security", "removal", "other")
LEVELS = ("low", "medium", "high")
CODE_LANGUAGES = (
    "python", "javascript", "typescript", "go", "java", "kotlin", "ruby", "csharp", "rust", "php", "scala", "shell", "powershell", "sql")
REVIEW_KINDS = ("modified", "renamed", "added", "mode-changed", "removed")
TASK_ITEMS = 20_000
ANSWER = ("headline string, summary string, risk string, risk_reason string, "
          "changes array<struct<kind:string,title:string,detail:string,files:array<string>>>, "
          "risks array<struct<level:string,title:string,detail:string,files:array<string>>>, checklist array<string>")


def priority(path: Column, lang: Column, kind: Column, lines: Column, module: Column | None = None) -> list[Column]:
    """Reading order: the entry point, code, kind of change, big edits, path."""
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    entry = F.lit(1) if module is None else F.when((stem == module) | stem.endswith(F.concat(F.lit("/"), module)), 0).otherwise(1)
    code = F.when(lang.isin(*CODE_LANGUAGES), 0).otherwise(1)
    place = F.array_position(F.array(*[F.lit(k) for k in REVIEW_KINDS]), kind)
    return [entry, code, place, -lines, path]


def prefix_pack(items: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int, options: ReviewOptions = ReviewOptions()) -> DataFrame:
    """Running use of a budget in priority order; an item past it is left out.

    Each item counts at most ``max(min_item_cap, budget/3)``. Running sums are
    computed in slices, so a comparison of any size is spread over tasks.
    """
    cap = max(options.min_item_cap, budget // 3)
    sized = items.withColumn("charged", F.least(size, F.lit(cap)).cast("bigint"))
    packed = ordered(sized, keys, order, running={"used": "charged"}, number="position")
    return packed.withColumn("included", F.col("used") <= budget)


def _fill(keys: list[str]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        room = int(group["_room"].iloc[0])
        out = []
        for size in group.sort_values("_place")["_size"]:
            fits = size <= room
            room -= size if fits else 0
            out.append(bool(fits))
        return group.sort_values("_place").assign(included=out).drop(columns=["_room"])

    return run


def greedy_fill(items: DataFrame, keys: list[str], order: list[Column], size: Column, capacity: int, task_items: int = TASK_ITEMS) -> DataFrame:
    """In order, take each item that still fits; an item that does not is passed over.

    Groups of at most ``task_items`` are folded one task each. A larger group first
    takes its longest fitting prefix by a distributed running sum, drops what can no
    longer fit, and repeats on the rest, so no larger group meets in one task and
    the outcome is that of the one-by-one rule.
    """
    rest = durable(ordered(items, keys, order, number="_place").withColumn("_size", size.cast("bigint")).withColumn("_room", F.lit(capacity).cast("bigint")))
    plain = [c for c in rest.columns if c != "_room"]
    schema = ", ".join(f"`{n}` {t}" for n, t in rest.select(*plain).dtypes) + ", included boolean"
    done: list[DataFrame] = []
    while True:
        large = rest.groupBy(*keys).count().where(F.col("count") > task_items).select(*keys)
        if large.isEmpty():
            done.append(rest.groupBy(*keys).applyInPandas(_fill(keys), schema))
            break
        done.append(rest.join(large, keys, "left_anti").groupBy(*keys).applyInPandas(_fill(keys), schema))
        summed = durable(ordered(rest.join(large, keys, "left_semi"), keys, [F.col("_place")], running={"_sum": "_size"}))
        stop = summed.where(F.col("_sum") > F.col("_room")).groupBy(*keys).agg(F.min("_place").alias("_stop"))
        cut = summed.join(stop, keys, "left")
        inside = F.col("_stop").isNull() | (F.col("_place") < F.col("_stop"))
        done.append(cut.where(inside).select(*plain, F.lit(True).alias("included")))
        taken = cut.where(inside).groupBy(*keys).agg(F.sum("_size").alias("_taken"))
        left = cut.where(~inside).join(taken, keys, "left").withColumn("_room", F.col("_room") - F.coalesce("_taken", F.lit(0)))
        left = durable(left)
        done.append(left.where(F.col("_size") > F.col("_room")).select(*plain, F.lit(False).alias("included")))
        rest = left.where(F.col("_size") <= F.col("_room")).select(*rest.columns)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("_place", "_size")


def _pack(budget: int, options: ReviewOptions):
    cap = max(options.min_item_cap, budget // 3)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, rows = group.sort_values("_place"), []
        used = int(group["_used"].iloc[0])
        for title, body in zip(group["title_chars"], group["body_chars"]):
            room = min(cap, budget - used - title - options.title_overhead)
            sent = room >= options.min_room
            quoted = min(int(body), room) if sent else 0
            used += title + 1 + quoted + 2 if sent else 0
            rows.append((sent, quoted, used))
        out = group.drop(columns=["_used"])
        out["included"], out["quoted_chars"], out["used"] = zip(*rows)
        return out

    return run


def pack_sections(items: DataFrame, keys: list[str], order: list[Column], head_chars: str, budget: int, options: ReviewOptions = ReviewOptions(), task_items: int = TASK_ITEMS) -> DataFrame:
    """Which items a budget shows, and how much of each.

    Room for an item is what is left after its title, at most a third of the budget;
    under ``min_room`` it is left out, and later smaller ones may still fit. Items are
    folded ``task_items`` at a time per comparison; a comparison goes on to its next
    chunk with what it has used, until its items end or nothing more can fit.
    """
    ranked = durable(ordered(items, keys, order, number="_place").withColumn("_chunk", F.floor((F.col("_place") - 1) / task_items)).withColumn(
        "_used", F.col(head_chars).cast("bigint")))
    plain = [c for c in ranked.columns if c != "_used"]
    schema = ", ".join(f"`{n}` {t}" for n, t in ranked.select(*plain).dtypes) + ", included boolean, quoted_chars long, used long"
    chunk, done, rest = 0, [], ranked
    while True:
        now = durable(rest.where(F.col("_chunk") == chunk).groupBy(*keys).applyInPandas(_pack(budget, options), schema))
        done.append(now)
        rest = rest.where(F.col("_chunk") > chunk)
        if rest.isEmpty():
            break
        state = now.groupBy(*keys).agg(F.max("used").alias("_now"))
        rest = rest.join(state, keys, "left").withColumn("_used", F.coalesce("_now", "_used")).drop("_now")
        full = F.col("_used") > budget - options.min_room - options.title_overhead
        done.append(rest.where(full).select(*plain, F.lit(False).alias("included"), F.lit(0).cast("bigint").alias("quoted_chars"), F.col("_used").alias("used")))
        rest, chunk = durable(rest.where(~full)), chunk + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("_place", "_chunk")


def mount_tiers(files: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Tier of each file: 0 changed, 1 in a changed file's folder, 2 the rest.

    ``files`` and ``changed``: keys, is_new, path. Both lookups are joins on
    de-duplicated keys.
    """
    exact = changed.select(*keys, "is_new", "path").distinct().withColumn("_changed", F.lit(True))
    near = changed.select(*keys, paths.dirname(F.col("path")).alias("_dir")).distinct().withColumn("_near", F.lit(True))
    marked = files.withColumn("_dir", paths.dirname(F.col("path"))).join(exact, [*keys, "is_new", "path"], "left").join(near, [*keys, "_dir"], "left")
    tier = F.when(F.col("_changed"), 0).when(F.col("_near"), 1).otherwise(2)
    return marked.withColumn("tier", tier).drop("_changed", "_near", "_dir")


def tiered_budget(files: DataFrame, changed: DataFrame, keys: list[str], total: int, per_file: int) -> DataFrame:
    """Which files of both versions are mounted under a total, and why the others are not.

    ``files``: keys, is_new, path, size, is_text. Tiers first, then path, the newer copy first.
    """
    tiers = mount_tiers(files, changed, keys)
    refusal = (
        F.when(F.col("path").rlike(paths.WITHHELD_PATTERN), "contents withheld")
        .when(F.col("size") > per_file, "too large to read").when(~F.col("is_text"), "binary")
    )
    marked = tiers.withColumn("reason", refusal)
    open_files = marked.where(F.col("reason").isNull()).drop("reason").withColumn("_pos", F.col("tier").cast("bigint"))
    order = [F.col("_pos"), F.col("path"), (~F.col("is_new")).cast("int")]
    filled = greedy_fill(open_files, keys, order, F.col("size"), total).drop("_pos")
    return filled.withColumn("reason", F.when(~F.col("included"), "past the size limit")).unionByName(
        marked.where(F.col("reason").isNotNull()).withColumn("included", F.lit(False)))


def clip(value: Column, limit: int | None) -> Column:
    """Collapse spaces and cut to ``limit`` characters, if there is one, with an ellipsis."""
    text = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    if limit is None:
        return text
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…")))


def level(value: Column, default: str = "") -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin(*LEVELS), low).otherwise(default)


def json_span(answer: Column) -> Column:
    """The first JSON object of a free text, as text; null when there is none.

    A fenced object first, then the outermost braces, then from the second and
    third opening brace to the last closing one.
    """
    stripped = F.trim(answer)
    fenced = F.regexp_extract(stripped, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(stripped)
    outer = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    second = F.regexp_extract(outer, r"(?s)^\{[^{]*(\{.*\})", 1)
    third = F.regexp_extract(second, r"(?s)^\{[^{]*(\{.*\})", 1)

    def valid(candidate: Column) -> Column:
        return F.when((candidate != "") & F.try_parse_json(candidate).isNotNull(), candidate)

    return F.coalesce(valid(outer), valid(second), valid(third))


def parse_answers(answers: DataFrame, key: str = "id", column: str = "text", options: AnswerOptions = AnswerOptions()) -> DataFrame:
    """Answers as typed columns; prose without JSON is kept as the summary.

    Lists and texts are whole unless ``options`` limits them; unknown kinds and levels become
    their defaults. Citations are left raw: see ``resolve_citations``.
    """
    spans = answers.select(key, F.col(column).alias("_text"), json_span(F.col(column)).alias("_json"))
    parsed = spans.withColumn("_a", F.from_json("_json", ANSWER))
    a = F.col("_a")
    prose = F.trim(F.col("_text"))
    structured = F.col("_json").isNotNull()

    def cited(item: Column) -> Column:
        return F.coalesce(item["files"], F.array().cast("array<string>"))

    def kind(item: Column) -> Column:
        low = F.lower(F.trim(item["kind"]))
        return F.when(low.isin(*CHANGE_KINDS), low).otherwise("other")

    changes = F.transform(F.filter(a["changes"], lambda i: F.coalesce(i["title"], F.lit("")) != ""), lambda i: F.struct(
        kind(i).alias("kind"), clip(i["title"], options.title_chars).alias("title"), clip(i["detail"], options.detail_chars).alias("detail"), cited(i).alias("files")))
    risks = F.transform(F.filter(a["risks"], lambda i: F.coalesce(i["title"], F.lit("")) != ""), lambda i: F.struct(
        level(i["level"], "medium").alias("kind"), clip(i["title"], options.title_chars).alias("title"), clip(i["detail"], options.detail_chars).alias("detail"), cited(i).alias("files")))
    steps = F.transform(F.filter(a["checklist"], lambda s: F.trim(F.coalesce(s, F.lit(""))) != ""), lambda s: clip(s, options.step_chars))
    nothing = F.array()

    def first(items: Column, limit: int | None) -> Column:
        return F.coalesce(items if limit is None else F.slice(items, 1, limit), nothing)

    first_sentence = F.split(prose, r"(?<=[.!?])\s", 2).getItem(0)
    return parsed.select(
        key, structured.alias("structured"),
        F.when(structured, clip(a["headline"], options.headline_chars)).otherwise(clip(first_sentence, options.headline_chars)).alias("headline"),
        F.when(structured, clip(a["summary"], options.summary_chars)).otherwise(clip(prose, options.prose_chars)).alias("summary"),
        level(a["risk"]).alias("risk"), clip(a["risk_reason"], options.reason_chars).alias("risk_reason"),
        first(changes, options.changes).alias("changes"), first(risks, options.risks).alias("risks"), first(steps, options.steps).alias("checklist"))


def cleaned_citation(cited: Column) -> Column:
    """A citation without quotes, version prefixes and a line number."""
    text = F.trim(F.regexp_replace(F.trim(cited), "^[`'\"]+|[`'\"]+$", ""))
    for prefix in ("/old/", "/new/", "a/", "b/", "./"):
        text = F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)
    return F.trim(F.split(text, ":").getItem(0))


def resolve_citations(citations: DataFrame, known: DataFrame, scope: list[str]) -> DataFrame:
    """The known path a citation means: itself, else the only path ending in it.

    ``citations``: scope, cited; ``known``: scope, path. A path that is known as
    written is kept before any prefix comes off. Suffixes of known paths are counted
    per (scope, suffix) by an aggregate, and ambiguous ones drop out before the join.
    """
    raw = F.trim(F.regexp_replace(F.trim(F.col("cited")), "^[`'\"]+|[`'\"]+$", ""))
    asks = citations.select(*scope, "cited", raw.alias("_raw"), cleaned_citation(F.col("cited")).alias("_clean"))
    exact = known.select(*scope, "path").distinct()
    parts = F.split("path", "/")
    suffixes = exact.select(*scope, "path", F.explode(F.transform(
        F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("_clean")) \
        .where(F.col("_clean") != F.col("path"))
    only = suffixes.groupBy(*scope, "_clean").agg(F.min("path").alias("_lo"), F.max("path").alias("_hi")).where(
        F.col("_lo") == F.col("_hi")).select(*scope, "_clean", F.col("_lo").alias("_by_tail"))
    as_is = exact.select(*scope, F.col("path").alias("_raw"), F.col("path").alias("_by_raw"))
    stripped = exact.select(*scope, F.col("path").alias("_clean"), F.col("path").alias("_by_clean"))
    return asks.join(as_is, [*scope, "_raw"], "left").join(stripped, [*scope, "_clean"], "left").join(only, [*scope, "_clean"], "left").select(
        *scope, "cited", F.coalesce("_by_raw", "_by_clean", "_by_tail").alias("path"))


def dependency_line() -> Column:
    """``- boto3 (pip, installed): 1.34.0 → 1.35.20`` for a keyed change."""
    source = F.when(F.col("is_declared"), "declared").otherwise("installed")
    unknown = F.lit("unspecified version")
    moved = (
        F.when(F.col("kind") == "changed", F.concat(F.coalesce("old_version", F.lit("None")), F.lit(" → "), F.coalesce("new_version", F.lit("None"))))
        .when(F.col("kind") == "added", F.concat(F.lit("added at "), F.coalesce("new_version", unknown)))
        .otherwise(F.concat(F.lit("removed (was "), F.coalesce("old_version", unknown), F.lit(")")))
    )
    return F.concat(F.lit("- "), "name", F.lit(" ("), "manager", F.lit(", "), source, F.lit("): "), moved)


def finding_line() -> Column:
    """``- NEW high stripe-key at config.py:7 (sk_l…dc (32 chars))``."""
    return F.concat(F.lit("- NEW "), "severity", F.lit(" "), "kind", F.lit(" at "), "path", F.lit(":"), F.col("line_no").cast("string"), F.lit(" ("), "detail", F.lit(")"))


def name_line() -> Column:
    """``- newly read: QUEUE_URL`` for a reference that came or went."""
    return F.concat(F.when(F.col("status") == "added", "- newly read: ").otherwise("- no longer read: "), F.col("name"))


def section(rows: DataFrame, keys: list[str], order: list[Column], line: Column, number: int, title: str, limit: int) -> DataFrame:
    """A brief's section: the first ``limit`` lines, then how many more there are.

    The cut is made before the shuffle and the rest is only counted.
    """
    first = top_per_group(rows, keys, order, limit, "line_order").select(*keys, "line_order", line.alias("line"))
    more = rows.groupBy(*keys).agg((F.count(F.lit(1)) - limit).alias("_more")).where(F.col("_more") > 0).select(
        *keys, F.lit(limit + 1).alias("line_order"), F.concat(F.lit("- … and "), F.col("_more").cast("string"), F.lit(" more")).alias("line"))
    return first.unionByName(more).select(*keys, F.lit(number).alias("section"), F.lit(title).alias("title"), "line_order", "line")


def brief(overview: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """One text per comparison: overview lines, then titled sections of bounded length.

    ``overview``: keys, text. ``sections``: keys, section (order), title, line_order,
    line; already cut to their limits per section, which bounds what is collected.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_order", "line"))), lambda e: e["line"])
    one = sections.groupBy(*keys, "section", "title").agg(F.array_join(lines, "\n").alias("body"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("section", "title", "body"))), lambda s: F.concat(F.lit("\n\n## "), s["title"], F.lit("\n"), s["body"]))
    bodies = one.groupBy(*keys).agg(F.array_join(text, "").alias("_body"))
    return overview.join(bodies, keys, "left").select(*keys, F.concat("text", F.coalesce("_body", F.lit(""))).alias("brief"))
