"""Version history: outcomes, numbering, selection, retention, merging, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable, fetch
from .ordered import ordered, top_per_group


def ingest_outcomes(
    arrivals: DataFrame, seen: DataFrame | None = None, versions: DataFrame | None = None, order: tuple[str, str] = ("ts", "event_id"),
) -> DataFrame:
    """What became of each arrival: duplicate-download, unchanged, or new with a number.

    ``arrivals``: order columns (unique together), artifact, archive_key, tree_key.
    Archive bytes seen anywhere before are a duplicate; a tree already under this
    artifact (any earlier version) is unchanged and reports that version's number;
    else it is new. ``seen`` (archive_key) and ``versions`` (artifact, tree_key, seq)
    are what earlier batches stored.

    The first arrival of each archive is a minimum per key, so a key with very many
    arrivals costs one combined row per partition, and only those firsts go on to the
    tree check and numbering. All arrivals meet the result once, on their unique order.
    """
    order = list(order)
    first = arrivals.groupBy("archive_key").agg(F.min(F.struct(*order, "artifact", "tree_key")).alias("_f")).select("archive_key", "_f.*")
    first = durable(first)
    if seen is not None:
        # The batch's keys go to the stored ones, not the stored ones to a shuffle.
        old = fetch(seen.select("archive_key"), first.select("archive_key"), ["archive_key"], "left_semi")
        first = durable(first.join(old.distinct(), "archive_key", "left_anti"))
    trees = first.groupBy("artifact", "tree_key").agg(F.min(F.struct(*order)).alias("_at"))
    if versions is not None:
        versions = fetch(versions, first.select("artifact").distinct(), ["artifact"], "left_semi")
        known = versions.groupBy("artifact", "tree_key").agg(F.max("seq").alias("_known"))
        highest = versions.groupBy("artifact").agg(F.max("seq").alias("_highest"))
        trees = trees.join(known, ["artifact", "tree_key"], "left").join(highest, "artifact", "left")
    else:
        trees = trees.withColumn("_known", F.lit(None).cast("bigint")).withColumn("_highest", F.lit(0).cast("bigint"))
    trees = trees.select("artifact", "tree_key", *[F.col("_at")[c].alias(f"_n_{c}") for c in order], "_known", F.coalesce("_highest", F.lit(0)).alias("_highest"))
    opened = ordered(trees.where(F.col("_known").isNull()), ["artifact"], [F.col(f"_n_{c}") for c in order], number="_n")
    numbered = opened.withColumn("_seq", (F.col("_n") + F.col("_highest")).cast("bigint")).drop("_n").unionByName(
        trees.where(F.col("_known").isNotNull()).withColumn("_seq", F.col("_known").cast("bigint")))
    same = numbered.withColumnRenamed("artifact", "_artifact").withColumnRenamed("tree_key", "_tree_key")
    # Null-safe: an arrival no artifact was found for is judged like any other.
    judged = first.join(same, F.col("artifact").eqNullSafe(F.col("_artifact")) & F.col("tree_key").eqNullSafe(F.col("_tree_key")))
    is_new = F.col("_known").isNull()
    for c in order:
        is_new = is_new & (F.col(c) == F.col(f"_n_{c}"))
    judged = judged.select("archive_key", *order, F.when(is_new, "new").otherwise("unchanged").alias("status"), F.col("_seq").alias("seq"))
    out = arrivals.join(judged, ["archive_key", *order], "left")
    return out.withColumn("status", F.coalesce("status", F.lit("duplicate-download")))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("arrivals"))


def seen_counters(arrivals: DataFrame, key: str = "archive_key", source: str = "kind", order: tuple[str, str] = ("ts", "event_id")) -> DataFrame:
    """First and last sight, times seen, and the first arrival's source name per content."""
    ts = order[0]
    return arrivals.groupBy(key).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("times_seen"),
        F.min_by(source, F.struct(*order)).alias("source_name"))


def first_last_seen(rows: DataFrame, ts: str = "ts") -> DataFrame:
    return rows.groupBy("artifact").agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def version_steps(versions: DataFrame) -> DataFrame:
    """Each version with the greatest lower one: (artifact, old_seq, new_seq)."""
    steps = ordered(versions.select("artifact", "seq"), ["artifact"], [F.col("seq")], previous={"old_seq": "seq"})
    return steps.where(F.col("old_seq").isNotNull()).select("artifact", "old_seq", F.col("seq").alias("new_seq"))


def latest_version(versions: DataFrame, columns: list[str]) -> DataFrame:
    """The newest row per artifact by an aggregate, not a sort."""
    rest = [c for c in columns if c != "seq"]
    best = versions.groupBy("artifact").agg(F.max(F.struct("seq", *rest)).alias("_v"))
    return best.select("artifact", F.col("_v.seq").alias("seq"), *[F.col("_v")[c].alias(c) for c in rest])


def retention(versions: DataFrame, keep: int) -> DataFrame:
    """Newest ``keep`` versions per artifact; 0 keeps all. Limited before the shuffle."""
    if keep <= 0:
        return versions
    return top_per_group(versions, ["artifact"], [F.col("seq").desc()], keep, "_age").drop("_age")


def renumber(versions: DataFrame, order: list[str]) -> DataFrame:
    """Numbers 1.. per artifact by archive time then old number."""
    return ordered(versions, ["artifact"], [F.col(c) for c in order], number="new_seq")


def merge_artifacts(versions: DataFrame, mapping: DataFrame, order: list[str]) -> DataFrame:
    """Move artifacts into others and renumber every touched one by archive time.

    ``mapping`` holds (source, target). Untouched artifacts keep their numbers.
    """
    moved = versions.join(mapping.withColumnRenamed("source", "artifact"), "artifact", "left")
    named = moved.withColumn("origin", F.col("artifact")).withColumn("artifact", F.coalesce("target", "artifact")).drop("target")
    touched = mapping.select(F.col("target").alias("artifact")).distinct().withColumn("_touched", F.lit(True))
    flagged = named.join(touched, "artifact", "left")
    again = renumber(flagged.where(F.col("_touched")), order)
    same = flagged.where(F.col("_touched").isNull()).withColumn("new_seq", F.col("seq").cast("bigint"))
    return again.unionByName(same.select(*again.columns)).drop("_touched")


def heal_collisions(versions: DataFrame, order: list[str]) -> DataFrame:
    """Renumber an artifact whose numbers repeat or are missing (0); leave the others."""
    per_number = versions.groupBy("artifact", "seq").agg(F.count(F.lit(1)).alias("_n"))
    broken = per_number.groupBy("artifact").agg(F.max("_n").alias("_most"), F.min("seq").alias("_low")).where(
        (F.col("_most") > 1) | (F.col("_low") == 0)).select("artifact", F.lit(True).alias("_broken"))
    flagged = versions.join(broken, "artifact", "left")
    again = renumber(flagged.where(F.col("_broken")), order).withColumn("healed", F.lit(True))
    same = flagged.where(F.col("_broken").isNull()).withColumn("new_seq", F.col("seq").cast("bigint")).withColumn("healed", F.lit(False))
    return again.unionByName(same.select(*again.columns)).drop("_broken")


def resolve_selectors(versions: DataFrame, selectors: DataFrame) -> DataFrame:
    """Version numbers for selector texts, with the reason where there is none.

    ``selectors`` holds (artifact, selector, default_offset). latest/last/head and
    first/oldest are extremes; a number or v-number must exist; -k counts from the
    newest; null takes the default offset, clamped to the oldest. Only artifacts that
    some selector asks for by place are ranked, in slices when they are large.
    """
    text = F.lower(F.trim(F.col("selector")))
    bare = F.regexp_replace(text, "^v", "")
    number = F.when(bare.rlike(r"^[+-]?\d+$"), F.expr("try_cast(regexp_replace(lower(trim(selector)), '^v', '') AS bigint)"))
    asked = (
        selectors.withColumn("_number", number)
        .withColumn("_place", F.when(F.col("selector").isNull(), F.col("default_offset") + 1).when(F.col("_number") < 0, -F.col("_number")))
    )
    ends = versions.groupBy("artifact").agg(F.min("seq").alias("_first"), F.max("seq").alias("_last"), F.count(F.lit(1)).alias("_count"))
    by_place = asked.where(F.col("_place").isNotNull()).select("artifact").distinct()
    numbered = ordered(
        versions.select("artifact", "seq").join(by_place, "artifact", "left_semi"), ["artifact"], [F.col("seq").desc()], number="_place"
    ).select("artifact", F.col("_place").cast("bigint").alias("_want"), F.col("seq").alias("_at_place"))
    exact = versions.select("artifact", F.col("seq").cast("bigint").alias("_number"), F.col("seq").alias("_exact")).distinct()
    clamped = F.when(F.col("selector").isNull(), F.least(F.col("_place"), F.col("_count"))).otherwise(F.col("_place")).cast("bigint")
    joined = asked.join(ends, "artifact", "left").withColumn("_want", clamped).join(numbered, ["artifact", "_want"], "left").join(exact, ["artifact", "_number"], "left")
    seq = (
        F.when(F.col("_count").isNull(), None)
        .when(F.col("selector").isNull() | (F.col("_number") < 0), F.col("_at_place"))
        .when(text.isin("latest", "last", "head"), F.col("_last"))
        .when(text.isin("first", "oldest"), F.col("_first"))
        .otherwise(F.col("_exact"))
    )
    reason = (
        F.when(F.col("_count").isNull(), "no versions")
        .when(F.col("selector").isNull() | text.isin("latest", "last", "head", "first", "oldest"), None)
        .when(F.col("_number").isNull(), "not understood")
        .when((F.col("_number") < 0) & F.col("_at_place").isNull(), F.concat(F.lit("only "), F.col("_count").cast("string"), F.lit(" versions")))
        .when((F.col("_number") >= 0) & F.col("_exact").isNull(), "not found")
    )
    return joined.select("artifact", "selector", "default_offset", seq.cast("bigint").alias("seq"), reason.alias("reason"))


def timeline(versions: DataFrame, size: str, attributes: list[str]) -> DataFrame:
    """Size change since the previous and the first version, and which attributes moved."""
    steps = ordered(versions, ["artifact"], [F.col("seq")],
                    previous={"_size": size, **{f"_was_{a}": a for a in attributes}, "previous_seq": "seq"})
    first = versions.groupBy("artifact").agg(F.min_by(size, "seq").alias("_first"))
    moved = [
        F.coalesce(F.col(f"_was_{a}").isNotNull() & ~F.col(f"_was_{a}").eqNullSafe(F.col(a)), F.lit(False)).alias(f"{a}_moved") for a in attributes]
    return steps.join(first, "artifact").select(
        "artifact", "seq", "previous_seq", size, (F.col(size) - F.col("_size")).alias("delta"), (F.col(size) - F.col("_first")).alias("delta_first"), *moved)


def missing_steps(steps: DataFrame, records: DataFrame, refresh: bool = False, engine: str | None = None) -> DataFrame:
    """Consecutive steps without a finished record; with ``engine`` without one by it (column ``engine``); all with ``refresh``."""
    if refresh:
        return steps
    if engine is not None:
        records = records.where(F.col("engine") == engine)
    return steps.join(records.select("artifact", "old_seq", "new_seq").distinct(), ["artifact", "old_seq", "new_seq"], "left_anti")


def latest_headlines(artifacts: DataFrame, steps: DataFrame, records: DataFrame) -> DataFrame:
    """Headline and risk of each artifact's latest step, null if it has no finished record."""
    last = steps.groupBy("artifact").agg(F.max(F.struct("new_seq", "old_seq")).alias("_s")).select(
        "artifact", F.col("_s.old_seq").alias("old_seq"), F.col("_s.new_seq").alias("new_seq"))
    done = records.where(F.col("status") == "done").select("artifact", "old_seq", "new_seq", "headline", "risk")
    return artifacts.join(last, "artifact", "left").join(done, ["artifact", "old_seq", "new_seq"], "left")


def is_stale(started: Column, as_of: Column, limit_seconds: int = 1200) -> Column:
    """Pending longer than the limit, or without a readable start."""
    return started.isNull() | ((F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(started.cast("timestamp"))) > limit_seconds)
