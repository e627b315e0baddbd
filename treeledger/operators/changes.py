"""Per-file change records, their order, directory moves and folder totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, paths, text
from ..options import CompareOptions
from . import similar, snapshot
from .durable import durable, fetch, fetch_measured
from .facts import count_if, file_facts, sum_if
from .snapshot import STEP

# Reading order of change kinds.
KIND_ORDER = ("modified", "added", "renamed", "removed", "mode-changed")


def renamed_and_changed(
    files: DataFrame, old_seq: int | None = None, new_seq: int | None = None, steps: DataFrame | None = None,
    options: CompareOptions = CompareOptions(), similar_pass: bool = True, ordered_ratio: bool = False,
) -> DataFrame:
    """All changes of each comparison with exact and similar renames folded in."""
    roles = snapshot.with_roles(file_facts(files), old_seq, new_seq, steps)
    diff = snapshot.stored_changes(roles)
    renames = snapshot.exact_renames(diff).select(*STEP, "old_path", "new_path")
    if similar_pass:
        renames = durable(renames)
        left = snapshot.without_renamed(diff, renames)
        found = similar.similar_renames(left, files, options, ordered_ratio)
        renames = renames.unionByName(found.select(*STEP, "old_path", "new_path"))
    return durable(snapshot.changed_files(diff, renames))


def _wanted(changes: DataFrame) -> DataFrame:
    """Where both sides of every change lie, of a stored table of changes; its keys go to the text, not the text to a shuffle."""
    return changes.select(
        *STEP, "path", F.explode(F.array(
            F.struct(F.col("old_seq").alias("seq"), F.coalesce("old_path", "path").alias("at"), F.lit(False).alias("is_new"), F.col("old").isNotNull().alias("there")),
            F.struct(F.col("new_seq").alias("seq"), F.col("path").alias("at"), F.lit(True).alias("is_new"), F.col("new").isNotNull().alias("there")),
        )).alias("s")
    ).where("s.there").select(*STEP, "path", "s.seq", "s.at", "s.is_new")


AT = ["artifact", "seq", "at"]


def _at(files: DataFrame) -> DataFrame:
    return files.select("artifact", "seq", F.col("path").alias("at"), "content")


def side_texts(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(comparison, path, is_new, content) of changed files."""
    return fetch(_at(files), _wanted(changes), AT).select(*STEP, "path", "is_new", "content")


def text_measures(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Line deltas, whitespace equality and mean line length per changed file.

    Texts are read for the changed keys alone where those are few; else the measures and line hashes of the rows
    that pass a sieve of the keys travel, never the text. Both sides of a change meet by one shuffle of a row per side; their
    lines are exploded behind it, where both aggregations find their rows in place, so no line carries the keys of
    its file to a shuffle. Files that kept their path are dealt by it on the way from their text; only those of a rename,
    which lie at two paths, are dealt again by the new one.
    """
    # Measured per text first: beside an explode they would run once per line.
    measures = [
        F.xxhash64(text.whitespace_key(F.col("content"))).alias("ws"), text.mean_line_length(F.col("content")).alias("mean"),
        (F.col("content") != "").alias("filled"), *text.line_hashes(F.col("content"))]
    moved = F.col("old_path").isNotNull()
    stayed = fetch_measured(_at(files), _wanted(changes.where(~moved)), AT, measures, by=["artifact", "at"]).drop("path").withColumnRenamed("at", "path")
    renamed = fetch_measured(_at(files), _wanted(changes.where(moved)), AT, measures).repartition(*STEP, "path")
    return _line_deltas(stayed).unionByName(_line_deltas(renamed))


def _line_deltas(sides: DataFrame) -> DataFrame:
    """One row per changed file from its one or two sides, which lie in one partition."""
    met = sides.select(*STEP, "path", "is_new", "ws", "mean", "filled", F.explode_outer(F.arrays_zip("h", "h2")).alias("line"))
    new, old = F.col("is_new"), ~F.col("is_new")
    line = F.col("line").isNotNull().cast("bigint")
    per_line = met.groupBy(*STEP, "path", F.col("line.h").alias("h"), F.col("line.h2").alias("h2")).agg(
        F.sum(F.when(old, line).otherwise(0)).alias("co"), F.sum(F.when(new, line).otherwise(0)).alias("cn"),
        F.max(F.when(old & F.col("filled"), F.col("ws"))).alias("ws_old"), F.max(F.when(new & F.col("filled"), F.col("ws"))).alias("ws_new"),
        F.max(F.when(old, F.col("mean"))).alias("mean_old"), F.max(F.when(new, F.col("mean"))).alias("mean_new"),
        F.min("is_new").alias("first_side"), F.max("is_new").alias("last_side"))
    return per_line.groupBy(*STEP, "path").agg(
        F.sum(F.greatest(F.col("cn") - F.col("co"), F.lit(0))).alias("added_lines"),
        F.sum(F.greatest(F.col("co") - F.col("cn"), F.lit(0))).alias("removed_lines"),
        F.max("ws_old").alias("ws_old"), F.max("ws_new").alias("ws_new"),
        F.max("mean_old").alias("mean_old"), F.max("mean_new").alias("mean_new"),
        (~F.min("first_side")).alias("has_old"), F.max("last_side").alias("has_new"))


def file_changes(changes: DataFrame, files: DataFrame, options: CompareOptions = CompareOptions()) -> DataFrame:
    """One record per change: what happened, line deltas, and why a count is blank.

    Line deltas compare bags of lines (order left out); ``lines.line_ops`` gives the
    ordered operations. Hidden vendored changes are kept, flagged ``is_hidden``.
    """
    old, new = F.col("old"), F.col("new")
    either = F.coalesce("new", "old")
    refused = (
        F.when(F.col("kind") == "mode-changed", "mode only")
        .when(paths.matches_any(F.col("path"), options.ignore_globs), "ignored by config")
        .when(~F.coalesce("old.is_text", F.lit(True)) | ~F.coalesce("new.is_text", F.lit(True)), "binary")
    )
    if options.max_compare_bytes is not None:
        size = F.greatest(F.coalesce("old.size", F.lit(0)), F.coalesce("new.size", F.lit(0)))
        refused = refused.when(size > options.max_compare_bytes, f"file larger than {options.max_compare_bytes // 1024} KB")
    marked = changes.withColumn("_refused", refused)
    measured = text_measures(marked.where(F.col("_refused").isNull()), files)
    both = F.col("_old") & F.col("_new")
    spaces_only = F.lit(options.collapse_whitespace) & both & F.col("content_differs") & (F.col("ws_old") == F.col("ws_new"))
    wide = both & (F.greatest("mean_old", "mean_new") > options.long_line_mean)
    absent = F.col("_refused").isNull() & (
        (F.col("_old") & ~F.coalesce("has_old", F.lit(False))) | (F.col("_new") & ~F.coalesce("has_new", F.lit(False))))
    # What a record says without its text, so that the facts of both sides stay behind.
    narrow = marked.select(
        *STEP, "kind", "path", "old_path", either["lang"].alias("lang"), snapshot.is_vendored_change().alias("is_vendor"),
        (snapshot.is_hidden_change() & F.lit(options.hide_vendored)).alias("is_hidden"),
        (F.coalesce("new.size", F.lit(0)) - F.coalesce("old.size", F.lit(0))).cast("bigint").alias("size_delta"),
        (~F.col("old.sha256").eqNullSafe(F.col("new.sha256"))).alias("content_differs"),
        old.isNotNull().alias("_old"), new.isNotNull().alias("_new"), "_refused")
    joined = narrow.join(measured, [*STEP, "path"], "left").select(
        *narrow.columns[:-3], F.coalesce(spaces_only, F.lit(False)).alias("whitespace_only"),
        (F.coalesce(wide, F.lit(False)) & ~F.coalesce(spaces_only, F.lit(False))).alias("long_lines"),
        F.when(absent, "missing from the archive").otherwise(F.col("_refused")).alias("_refused"), "added_lines", "removed_lines")
    counted = F.col("_refused").isNull() & ~F.col("whitespace_only") & ~F.col("long_lines")
    note = F.when(F.col("whitespace_only"), "whitespace only").when(F.col("long_lines"), "long lines").otherwise(
        F.when(F.col("_refused") != "mode only", F.col("_refused")))
    return joined.select(
        *STEP, "kind", "path", "old_path", "lang", "is_vendor", "is_hidden", "size_delta", "content_differs", "whitespace_only", "long_lines",
        F.when(counted, F.coalesce("added_lines", F.lit(0))).otherwise(0).cast("bigint").alias("added_lines"),
        F.when(counted, F.coalesce("removed_lines", F.lit(0))).otherwise(0).cast("bigint").alias("removed_lines"),
        note.alias("skipped_reason"))


def shown(changes: DataFrame) -> DataFrame:
    return changes.where(~F.col("is_hidden"))


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), kind).cast("int")


def change_counts(changes: DataFrame) -> DataFrame:
    """Listed changes per kind, every kind present, and the hidden vendored count."""
    listed = ~F.col("is_hidden")
    kinds = [count_if(listed & (F.col("kind") == k)).alias(k.replace("-", "_")) for k in KIND_ORDER]
    return changes.groupBy(*STEP).agg(*kinds, count_if(F.col("is_hidden")).alias("vendored_hidden"))


def comparison_totals(changes: DataFrame) -> DataFrame:
    """Counts per kind with line totals, uncounted files."""
    listed = ~F.col("is_hidden")
    kinds = [count_if(listed & (F.col("kind") == k)).alias(k.replace("-", "_")) for k in KIND_ORDER]
    return changes.groupBy(*STEP).agg(
        *kinds, count_if(F.col("is_hidden")).alias("vendored_hidden"),
        sum_if(listed, F.col("added_lines")).alias("added_lines"), sum_if(listed, F.col("removed_lines")).alias("removed_lines"),
        count_if(listed & (F.col("whitespace_only") | F.col("long_lines"))).alias("uncounted_files"),
    )


def comparison_layers(steps: DataFrame, totals: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Totals of every asked comparison with a count per other layer and whether it is empty.

    ``layers`` maps a name to rows keyed by step (dependency, name, finding or
    attribute changes); each is counted per step before it is joined.
    """
    out = steps.select(*STEP).join(totals, STEP, "left")
    for name, rows in layers.items():
        out = out.join(rows.groupBy(*STEP).agg(F.count(F.lit(1)).alias(name)), STEP, "left")
    numbers = [c for c in out.columns if c not in STEP]
    filled = out.na.fill(0, numbers)
    nothing = F.lit(True)
    for c in (*[k.replace("-", "_") for k in KIND_ORDER], "vendored_hidden", *layers):
        nothing = nothing & (F.col(c) == 0)
    return filled.withColumn("is_empty", nothing)


def headline(counts: dict[str, Column]) -> Column:
    """``2 modified, 1 added, 52 vendored``; 'no file changes' when nothing is listed."""
    parts = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}"))) for word, n in counts.items()]
    joined = F.concat_ws(", ", *parts)
    return F.when(joined == "", "no file changes").otherwise(joined)


def impact(added: Column, removed: Column, arrivals: dict[str, Column]) -> Column:
    """``+24/-5 lines · new: 1 env var``; '' when there is nothing to say."""
    moved = F.when((added > 0) | (removed > 0), F.concat(F.lit("+"), added.cast("string"), F.lit("/-"), removed.cast("string"), F.lit(" lines")))
    came = F.concat_ws(", ", *[F.when(n > 0, labels.plural(n, noun)) for noun, n in arrivals.items()])
    return F.concat_ws(" · ", moved, F.when(came != "", F.concat(F.lit("new: "), came)))


def summary_line(head: Column, effect: Column) -> Column:
    return F.concat_ws(" · ", head, F.when(effect != "", effect))


def with_moves(changes: DataFrame) -> DataFrame:
    """Listed changes with the folders of a rename that kept its file name."""
    kept = (F.col("kind") == "renamed") & (paths.basename(F.col("path")) == paths.basename(F.col("old_path"))) & (
        paths.dirname(F.col("path")) != paths.dirname(F.col("old_path")))
    return shown(changes).withColumn("old_dir", F.when(kept, paths.dirname(F.col("old_path")))).withColumn(
        "new_dir", F.when(kept, paths.dirname(F.col("path"))))


MOVE = [*STEP, "old_dir", "new_dir"]


def directory_moves(changes: DataFrame, old_files: DataFrame, min_files: int = CompareOptions.min_moved_files) -> DataFrame:
    """Renames folded into one row per (old folder, new folder).

    ``old_files`` (comparison, path) lists the old side; a folder's direct members
    are counted by an aggregate before they meet the moves.
    """
    if min_files <= 0:
        return with_moves(changes).groupBy(*MOVE).agg(F.count(F.lit(1)).alias("moved")).where(F.lit(False))
    groups = with_moves(changes).where(F.col("old_dir").isNotNull()).groupBy(*MOVE).agg(
        F.count(F.lit(1)).alias("moved"), count_if(F.col("content_differs")).alias("edited"),
        F.sum("size_delta").alias("size_delta"), F.sum("added_lines").alias("added_lines"), F.sum("removed_lines").alias("removed_lines"),
        F.min("is_vendor").alias("is_vendor"), F.min(F.struct(F.col("is_vendor").alias("v"), "path")).alias("_first"),
    ).where(F.col("moved") >= min_files)
    held = old_files.select(*STEP, paths.dirname(F.col("path")).alias("old_dir")).groupBy(*STEP, "old_dir").agg(F.count(F.lit(1)).alias("total_in_old_dir"))
    return groups.join(held, [*STEP, "old_dir"], "left").select(
        *MOVE, "moved", "edited", F.coalesce("total_in_old_dir", F.lit(0)).alias("total_in_old_dir"),
        (F.col("moved") >= F.coalesce("total_in_old_dir", F.lit(0))).alias("whole_dir"),
        "size_delta", "added_lines", "removed_lines", "is_vendor", F.col("_first")["path"].alias("first_path"))


def change_rows(changes: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows as listed: a folded move stands once, in place of its first member."""
    members = with_moves(changes).join(
        moves.select(*MOVE, "moved", "edited", "first_path"), MOVE, "left")
    row = members.where(F.col("moved").isNull() | (F.col("path") == F.col("first_path")))
    folded = F.col("moved").isNotNull()

    def display(folder: str) -> Column:
        return F.when(F.col(folder) == "", ".").otherwise(F.col(folder))

    return row.select(
        *STEP, F.when(folded, "move").otherwise(F.col("kind")).alias("row_kind"), "path", "old_path", "is_vendor",
        F.when(folded, display("old_dir")).alias("old_dir"), F.when(folded, display("new_dir")).alias("new_dir"),
        F.when(folded, F.col("moved")).alias("moved"), F.when(folded, F.col("edited")).alias("edited"),
        F.when(folded, F.lit(0)).otherwise(F.col("added_lines")).cast("bigint").alias("added_lines"),
        F.when(folded, F.lit(0)).otherwise(F.col("removed_lines")).cast("bigint").alias("removed_lines"))


def tree_rows(changes: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows of the folder tree: listed rows plus the edited members of folded moves."""
    rows = change_rows(changes, moves)
    folder = (
        F.when(F.col("row_kind") == "move", paths.rename_folder(F.col("old_dir"), F.col("new_dir")))
        .when(F.col("row_kind") == "renamed", paths.rename_folder(F.col("old_path"), F.col("path")))
        .otherwise(paths.dirname(F.col("path")))
    )
    files = F.when(F.col("row_kind") == "move", F.col("moved") - F.col("edited")).otherwise(1).cast("bigint")
    listed = rows.select(*STEP, folder.alias("folder"), files.alias("files"), "added_lines", "removed_lines")
    edited = with_moves(changes).join(moves.select(*MOVE), MOVE, "left_semi").where("content_differs")
    return listed.unionByName(edited.select(
        *STEP, paths.rename_folder(F.col("old_path"), F.col("path")).alias("folder"), F.lit(1).cast("bigint").alias("files"), "added_lines", "removed_lines"))


def folder_rollup(rows: DataFrame) -> DataFrame:
    """Totals of every folder and all its ancestors; '' is the root.

    Rows are summed per folder before they are spread over their ancestors, so the
    spread is over folders, and the hot root is reached by partial sums.
    """
    own = rows.groupBy(*STEP, "folder").agg(
        F.sum("files").alias("files"), F.sum("added_lines").alias("added_lines"), F.sum("removed_lines").alias("removed_lines"), F.count(F.lit(1)).alias("own_rows"))
    parts = F.filter(F.split("folder", "/"), lambda p: p != "")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    spread = own.select(*STEP, F.col("folder").alias("at"), F.explode(ancestors).alias("folder"), "files", "added_lines", "removed_lines", "own_rows")
    return spread.groupBy(*STEP, "folder").agg(
        F.sum("files").alias("files"), F.sum("added_lines").alias("added_lines"), F.sum("removed_lines").alias("removed_lines"),
        sum_if(F.col("at") == F.col("folder"), F.col("own_rows")).alias("own_rows"))


def folder_compact(rollup: DataFrame) -> DataFrame:
    """Fold chains of folders that hold only one folder each into one row.

    A folder is kept when it holds rows or does not hold exactly one folder; its
    label runs from just below its nearest kept ancestor. Kept ancestors are found
    by joining each folder's prefixes with the kept set.
    """
    below = rollup.where(F.col("folder") != "")
    children = below.groupBy(*STEP, paths.dirname(F.col("folder")).alias("folder")).agg(F.count(F.lit(1)).alias("children"))
    kept = (
        rollup.join(children, [*STEP, "folder"], "left")
        .where((F.col("folder") == "") | (F.col("own_rows") > 0) | (F.coalesce("children", F.lit(0)) != 1))
        .drop("children")
    )
    parts = F.split("folder", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    named = kept.where(F.col("folder") != "")
    above = (
        named.select(*STEP, "folder", F.explode(prefixes).alias("ancestor"))
        .join(kept.select(*STEP, F.col("folder").alias("ancestor")), [*STEP, "ancestor"])
        .groupBy(*STEP, "folder").agg(F.max_by("ancestor", F.length("ancestor")).alias("parent"))
    )
    label = F.when(F.col("parent") == "", F.col("folder")).otherwise(F.substring(F.col("folder"), F.length("parent") + 2, F.length("folder")))
    return named.join(above, [*STEP, "folder"]).select(
        *STEP, "folder", "parent", label.alias("label"), "files", "added_lines", "removed_lines")


def folder_rollup_fixed(rows: DataFrame) -> DataFrame:
    """Totals over the first two folder levels with Spark's own ``rollup``."""
    parts = F.split("folder", "/")
    two = rows.select(*STEP, F.get(parts, 0).alias("d1"), F.coalesce(F.get(parts, 1), F.lit("")).alias("d2"), "files", "added_lines", "removed_lines")
    levels = two.rollup(*STEP, "d1", "d2").agg(
        F.sum("files").alias("files"), F.sum("added_lines").alias("added_lines"), F.sum("removed_lines").alias("removed_lines"),
        F.grouping_id().alias("_g"))
    return levels.where(F.col("_g").isin(0, 1, 3)).drop("_g")
