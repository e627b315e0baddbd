"""Comparing two versions of a tree: fates of paths, exact renames, common paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable, fetch
from .ordered import ordered

STEP = ["artifact", "old_seq", "new_seq"]
FACTS = ["size", "sha256", "mode", "is_text", "is_vendor", "lang", "lines"]


def with_roles(files: DataFrame, old_seq: int | None = None, new_seq: int | None = None, steps: DataFrame | None = None) -> DataFrame:
    """Files of both versions of each comparison, tagged ``is_new``.

    Give one fixed pair of numbers, or ``steps`` (artifact, old_seq, new_seq).
    """
    if steps is None:
        return files.where(F.col("seq").isin(old_seq, new_seq)).select(
            F.lit(old_seq).alias("old_seq"), F.lit(new_seq).alias("new_seq"), (F.col("seq") == new_seq).alias("is_new"), "*"
        ).drop("seq")
    sides = steps.select(
        *STEP, F.explode(F.array(
            F.struct(F.col("old_seq").alias("seq"), F.lit(False).alias("is_new")),
            F.struct(F.col("new_seq").alias("seq"), F.lit(True).alias("is_new")))).alias("s")
    ).select(*STEP, "s.seq", "s.is_new")
    # Version keys go to the files: a version with very many files stays spread.
    return fetch(files, durable(sides), ["artifact", "seq"]).drop("seq")


def paired_facts(roles: DataFrame) -> DataFrame:
    """One row per comparison and path with the facts of each side as structs.

    A full outer join of two versions, done as one aggregation: one scan, one
    shuffle on (comparison, path), and no key can be hot because a path occurs at
    most twice.
    """
    facts = F.struct(*FACTS)
    return roles.groupBy(*STEP, "path").agg(
        F.max(F.when(~F.col("is_new"), facts)).alias("old"), F.max(F.when(F.col("is_new"), facts)).alias("new"))


def path_fate() -> Column:
    return (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old.sha256") != F.col("new.sha256"), "modified")
        .when(F.col("old.mode") != F.col("new.mode"), "mode-changed")
        .otherwise("unchanged")
    )


def snapshot_diff(roles: DataFrame) -> DataFrame:
    """Fate of every path of both versions, by path, content hash and mode only."""
    return paired_facts(roles).withColumn("kind", path_fate())


def exact_renames(diff: DataFrame) -> DataFrame:
    """Removed and added paths with equal content: i-th with i-th in path order.

    Hashes found on one side only leave before any ordering, by an aggregate that
    Spark combines before the shuffle; a hash shared by a great many copies is
    numbered in slices (see ``ordered``), and the pairing joins on the number, so no
    group of copies is ever collected or paired with itself.
    """
    moved = diff.where(F.col("kind").isin("added", "removed")).select(
        *STEP, "path", (F.col("kind") == "added").alias("is_new"),
        F.coalesce("new.sha256", "old.sha256").alias("sha256"))
    both = moved.groupBy(*STEP, "sha256").agg(F.min("is_new").alias("_lo"), F.max("is_new").alias("_hi")).where(
        F.col("_lo") != F.col("_hi")).select(*STEP, "sha256")
    shared = moved.join(both, [*STEP, "sha256"], "left_semi")
    ranked = ordered(shared, [*STEP, "sha256", "is_new"], [F.col("path")], number="n")
    return (
        ranked.groupBy(*STEP, "sha256", "n")
        .agg(F.max(F.when(~F.col("is_new"), F.col("path"))).alias("old_path"),
             F.max(F.when(F.col("is_new"), F.col("path"))).alias("new_path"))
        .where(F.col("old_path").isNotNull() & F.col("new_path").isNotNull())
        .drop("n")
    )


def without_renamed(diff: DataFrame, renames: DataFrame) -> DataFrame:
    """Added and removed rows that no rename explains."""
    gone = renames.select(*STEP, F.col("old_path").alias("path"), F.lit("removed").alias("kind"))
    came = renames.select(*STEP, F.col("new_path").alias("path"), F.lit("added").alias("kind"))
    return diff.where(F.col("kind").isin("added", "removed")).join(
        gone.unionByName(came), [*STEP, "path", "kind"], "left_anti")


def changed_files(diff: DataFrame, renames: DataFrame) -> DataFrame:
    """Every change as (kind, path, old_path, old, new), renames folded in."""
    old = diff.where(F.col("kind") == "removed").select(*STEP, F.col("path").alias("old_path"), "old")
    new = diff.where(F.col("kind") == "added").select(*STEP, F.col("path").alias("new_path"), "new")
    renamed = (
        renames.select(*STEP, "old_path", "new_path").join(old, [*STEP, "old_path"]).join(new, [*STEP, "new_path"])
        .select(*STEP, F.lit("renamed").alias("kind"), F.col("new_path").alias("path"), "old_path", "old", "new")
    )
    plain = diff.where(F.col("kind").isin("modified", "mode-changed")).unionByName(without_renamed(diff, renames))
    return plain.select(*STEP, "kind", "path", F.lit(None).cast("string").alias("old_path"), "old", "new").unionByName(renamed)


def stored_changes(roles: DataFrame) -> DataFrame:
    """The rows of a comparison that are not unchanged, materialised once.

    Rename detection, moves and per-file changes all read them; without this each
    branch would scan and hash the files again.
    """
    return durable(snapshot_diff(roles).where(F.col("kind") != "unchanged"))


def is_vendored_change() -> Column:
    return F.coalesce(F.col("new.is_vendor"), F.col("old.is_vendor"))


def is_hidden_change() -> Column:
    """Vendored adds, removes and edits are counted, not listed; renames stay visible."""
    return is_vendored_change() & F.col("kind").isin("added", "removed", "modified")
