"""Keyed differences of fact sets, edits by mapping, and cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Order in which dependency changes are listed.
CHANGE_ORDER = ("added", "changed", "removed")


def keyed_diff(old: DataFrame, new: DataFrame, artifact: list[str], name: str = "name", version: str = "version") -> DataFrame:
    """Added, changed and removed facts under (manager, lower name, is_declared).

    A missing version counts as the empty one. Of repeated keys the greatest row stands.
    """
    facts = [*artifact, "manager", name, version, "is_declared"]
    sides = old.select(*facts, F.lit(False).alias("is_new")).unionByName(new.select(*facts, F.lit(True).alias("is_new")))
    return keyed_diff_of(sides, artifact, name, version)


def keyed_diff_of(sides: DataFrame, artifact: list[str], name: str = "name", version: str = "version") -> DataFrame:
    """``keyed_diff`` of one relation that holds both sides, told apart by ``is_new``.

    Rows are dealt by the full key first and meet in one aggregation behind that one
    shuffle: keys hardly repeat, so combining before it would only sort every row.
    """
    key = [*artifact, "manager", "_key", "is_declared"]
    dealt = sides.select(
        *artifact, "manager", F.lower(name).alias("_key"), "is_declared",
        F.struct(F.lit(True).alias("there"), F.col(name).alias("name"), F.col(version).alias("version")).alias("fact"), "is_new").repartition(*key)
    both = dealt.groupBy(*key).agg(
        F.max(F.when(~F.col("is_new"), F.col("fact"))).alias("old"), F.max(F.when(F.col("is_new"), F.col("fact"))).alias("new"))
    changed = F.coalesce("old.version", F.lit("")) != F.coalesce("new.version", F.lit(""))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(changed, "changed")
    return both.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        *artifact, "kind", "manager", F.coalesce("new.name", "old.name").alias("name"),
        F.col("old.version").alias("old_version"), F.col("new.version").alias("new_version"), "is_declared")


def collapse_declared(changes: DataFrame, artifact: list[str]) -> DataFrame:
    """One row where the declared and the installed fact say the same; installed wins.

    A minimum over a struct, so copies are folded before the shuffle.
    """
    same = [*artifact, "manager", F.lower("name").alias("_key"), "kind", "old_version", "new_version"]
    return changes.groupBy(*same).agg(F.min(F.struct("is_declared", "name")).alias("_best")).select(
        *artifact, "kind", "manager", F.col("_best")["name"].alias("name"), "old_version", "new_version", F.col("_best")["is_declared"].alias("is_declared"))


def change_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in CHANGE_ORDER]), kind)


def name_delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Names on one side only, with status 'added' or 'removed'."""
    both = old.select(*keys, F.lit(0).alias("_s")).unionByName(new.select(*keys, F.lit(1).alias("_s")))
    sides = both.groupBy(*keys).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    return sides.where(F.col("_lo") == F.col("_hi")).select(*keys, F.when(F.col("_lo") == 1, "added").otherwise("removed").alias("status"))


def findings_delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Findings without a counterpart on the other side; the line is not part of the key."""
    def null_safe(a: DataFrame, b: DataFrame) -> Column:
        condition = F.lit(True)
        for k in keys:
            condition = condition & a[k].eqNullSafe(b[k])
        return condition

    old_keys, new_keys = old.select(*keys).distinct(), new.select(*keys).distinct()
    fresh = new.join(old_keys, null_safe(new, old_keys), "left_anti").withColumn("status", F.lit("new"))
    fixed = old.join(new_keys, null_safe(old, new_keys), "left_anti").withColumn("status", F.lit("fixed"))
    return fresh.unionByName(fixed)


def attribute_changes(old: DataFrame, new: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """One row per attribute that differs between two versions of a key."""
    sides = old.select(*keys, *[F.col(a).alias(f"_o_{a}") for a in attributes]).join(
        new.select(*keys, *[F.col(a).alias(f"_n_{a}") for a in attributes]), keys)
    entries = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"_o_{a}").cast("string").alias("was"), F.col(f"_n_{a}").cast("string").alias("now")) for a in attributes])
    return sides.select(*keys, F.explode(F.filter(entries, lambda e: ~e["was"].eqNullSafe(e["now"]))).alias("e")).select(
        *keys, "e.attribute", F.coalesce("e.was", F.lit("?")).alias("was"), F.coalesce("e.now", F.lit("?")).alias("now"))


def apply_edits(rows: DataFrame, edits: DataFrame, keys: list[str], columns: list[str], named: str | None = None) -> DataFrame:
    """Overwrite columns where an edit exists; a null in the edit clears the value.

    With ``named``, a column of ``edits`` that lists the columns each edit sets, an
    edit leaves the others alone.
    """
    sets_column = F.array(*map(F.lit, columns)) if named is None else F.col(named)
    marked = edits.select(*keys, sets_column.alias("_has"), *[F.col(c).alias(f"_e_{c}") for c in columns])
    out = rows.join(marked, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.array_contains("_has", c), F.col(f"_e_{c}")).otherwise(F.col(c)))
    return out.drop("_has", *[f"_e_{c}" for c in columns])


def cascade_delete(tables: dict[str, tuple[DataFrame, list[str]]], doomed: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the doomed keys; each names its key columns."""
    out = {}
    for name, (df, keys) in tables.items():
        gone = doomed.select(*[F.col(d).alias(k) for d, k in zip(doomed.columns, keys)])
        out[name] = df.join(gone, keys, "left_anti")
    return out


def upsert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Add rows whose key is not there yet; the existing row always stays.

    The first row per key by a minimum over a struct, combined before the shuffle.
    """
    rest = [c for c in existing.columns if c not in keys]
    both = existing.withColumn("_o", F.lit(0)).unionByName(incoming.withColumn("_o", F.lit(1)))
    return both.groupBy(*keys).agg(F.min(F.struct("_o", *rest)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def prefer_non_null(rows: DataFrame, keys: list[Column | str], value: str, position: str, columns: list[str]) -> DataFrame:
    """First row per key by position, but one with a value beats one without."""
    best = F.min(F.struct(F.col(value).isNull().alias("_null"), F.col(position).alias("_pos"), *[F.col(c).alias(f"_{c}") for c in columns]))
    return rows.groupBy(*keys).agg(best.alias("_r")).select("*", *[F.col("_r")[f"_{c}"].alias(c) for c in columns]).drop("_r")
