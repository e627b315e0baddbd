"""Renames with edits: candidate pairs, line similarity, one-to-one assignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths, text
from ..options import CompareOptions
from .alignment import aligned
from .durable import durable, fetch, fetch_measured
from .ordered import ordered
from .snapshot import STEP


def line_bag(contents: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of each content with their counts; a line travels as 96 hash bits. ``contents`` holds content, or its ``text.line_hashes``."""
    hashed = contents.select(*keys, *text.line_hashes(F.col("content"))) if "content" in contents.columns else contents
    lines = hashed.select(*keys, F.explode(F.arrays_zip("h", "h2")).alias("_line"))
    return lines.groupBy(*keys, F.col("_line.h").alias("line"), F.col("_line.h2").alias("line2")).agg(F.count(F.lit(1)).alias("c"))


def bag_ratio(overlap: Column, old_lines: Column, new_lines: Column) -> Column:
    return F.when(old_lines + new_lines == 0, F.lit(1.0)).otherwise(F.lit(2.0) * overlap / (old_lines + new_lines))


def pair_similarity(sides: DataFrame, keys: list[str]) -> DataFrame:
    """Line-bag similarity of the two contents under each key.

    ``sides`` holds keys, ``is_new`` and ``content``; one aggregation per line and
    one per key, no join.
    """
    bag = line_bag(sides, [*keys, "is_new"])
    per_line = bag.groupBy(*keys, "line", "line2").agg(
        F.sum(F.when(~F.col("is_new"), F.col("c")).otherwise(0)).alias("co"),
        F.sum(F.when(F.col("is_new"), F.col("c")).otherwise(0)).alias("cn"))
    return per_line.groupBy(*keys).agg(
        F.sum(F.least("co", "cn")).alias("overlap"), F.sum("co").alias("old_lines"), F.sum("cn").alias("new_lines"),
        F.sum(F.greatest(F.col("cn") - F.col("co"), F.lit(0))).alias("added_lines"),
        F.sum(F.greatest(F.col("co") - F.col("cn"), F.lit(0))).alias("removed_lines"),
    ).withColumn("ratio", F.round(bag_ratio(F.col("overlap"), F.col("old_lines"), F.col("new_lines")), 6))


def content_classes(contents: DataFrame, by_content: bool = False) -> tuple[DataFrame, DataFrame]:
    """(classes, bag): contents that no other-side content can tell apart share a class.

    A line the other side never has only counts in a content's length, so contents
    with equal length and equal lines shared with the other side score alike against
    everything: copies that differ by a line of their own are one class. ``by_content``
    keeps every content its own class.

    ``classes``: step, is_new, sha256, class, n. ``bag``: the shared lines of one
    content per class, with how many classes hold each line.
    """
    content = [*STEP, "is_new", "sha256"]
    bag = durable(line_bag(contents, content))  # read by the branches below
    both_sides = bag.groupBy(*STEP, "line", "line2").agg(F.min("is_new").alias("_lo"), F.max("is_new").alias("_hi")).where(
        F.col("_lo") != F.col("_hi")).select(*STEP, "line", "line2")
    shared = durable(bag.join(both_sides, [*STEP, "line", "line2"], "left_semi"))  # read by both branches below
    sizes = bag.groupBy(*content).agg(F.sum("c").alias("n"))
    marks = shared.groupBy(*content).agg(
        F.count(F.lit(1)).alias("_k"), F.bit_xor(F.xxhash64("line", "line2", "c")).alias("_x"), F.bit_xor(F.xxhash64("c", "line2", "line", F.lit(7))).alias("_y"))
    name = F.col("sha256") if by_content else F.concat_ws("-", "n", "_k", "_x", "_y")
    classes = durable(sizes.join(marks, content).select(*content, name.alias("class"), "n"))
    one_each = classes.groupBy(*STEP, "is_new", "class", "n").agg(F.min("sha256").alias("sha256"))
    return classes, durable(shared.join(one_each, content).drop("sha256"))


def similar_classes(bag: DataFrame, threshold: float) -> DataFrame:
    """Every (old, new) pair of classes whose line bags reach ``threshold``.

    Exact prefix filtering: a pair at the threshold t shares at least
    ``a = t*n/(2-t)`` of the n lines of either side, so with lines ordered rare to
    common it must share one before the last ``a``. Only those prefixes meet in the
    join; common lines (blanks, licence text) fall in nobody's prefix unless a
    content has little else. No pair is lost and no line is dropped.
    """
    unit = [*STEP, "is_new", "class", "n"]
    frequency = bag.groupBy(*STEP, "line", "line2").agg(F.count(F.lit(1)).alias("df"))
    ranked = bag.join(frequency, [*STEP, "line", "line2"])
    one_class = Window.partitionBy(*unit)  # bounded by one content's distinct lines
    common_first = one_class.orderBy(F.col("df").desc(), F.col("line").desc(), F.col("line2").desc())
    need = F.ceil(F.lit(threshold) * F.col("n") / F.lit(2.0 - threshold) - 1e-9)
    prefixes = ranked.withColumn("_rest", F.sum("c").over(common_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("_rest") >= need)

    def side(is_new: bool, frame: DataFrame, *columns: Column) -> DataFrame:
        return frame.where(F.col("is_new") == is_new).select(*STEP, *columns)

    line = [F.col("line"), F.col("line2")]
    old, new = [F.col("class").alias("old_class"), F.col("n").alias("old_n")], [F.col("class").alias("new_class"), F.col("n").alias("new_n")]
    met = side(False, prefixes, *line, *old).join(side(True, prefixes, *line, *new), [*STEP, "line", "line2"])
    # The most two bags of these lengths can share already rules out unequal pairs.
    possible = bag_ratio(F.least("old_n", "new_n"), F.col("old_n"), F.col("new_n")) >= threshold - 1e-9
    pair = [*STEP, "old_class", "new_class", "old_n", "new_n"]
    candidates = met.where(possible).select(*pair).distinct()
    scored = (
        candidates.join(side(False, bag, *line, *old, F.col("c").alias("co")), [*STEP, "old_class", "old_n"])
        .join(side(True, bag, *line, *new, F.col("c").alias("cn")), [*STEP, "new_class", "new_n", "line", "line2"])
        .groupBy(*pair).agg(F.sum(F.least("co", "cn")).alias("overlap"))
    )
    return scored.withColumn("ratio", bag_ratio(F.col("overlap"), F.col("old_n"), F.col("new_n"))).where(F.col("ratio") >= threshold - 1e-9)


def similar_contents(contents: DataFrame, threshold: float) -> DataFrame:
    """Every (old_sha, new_sha) pair of contents whose line bags reach ``threshold``."""
    classes, bag = content_classes(contents)
    scores = similar_classes(bag, threshold).select(*STEP, "old_class", "new_class", "ratio")
    old = classes.where(~F.col("is_new")).select(*STEP, F.col("class").alias("old_class"), F.col("sha256").alias("old_sha"))
    new = classes.where("is_new").select(*STEP, F.col("class").alias("new_class"), F.col("sha256").alias("new_sha"))
    return scores.join(old, [*STEP, "old_class"]).join(new, [*STEP, "new_class"])


def with_ordered_ratio(pairs: DataFrame, contents: DataFrame, threshold: float, match: Callable[[DataFrame, list[str]], DataFrame] = aligned) -> DataFrame:
    """Replace the bag ratio by the ordered one, 2 matched / (old + new lines), for pairs that passed the bag gate.

    Classes are contents here; lines are matched by ``match``, a rule of ``alignment``.
    """
    pair = [*STEP, "old_class", "new_class"]

    def side(is_new: bool, name: str) -> DataFrame:
        mine = contents.where(F.col("is_new") == is_new).select(*STEP, F.col("sha256").alias(name), F.posexplode(text.lines_of(F.col("content"))).alias("no", "item"))
        return pairs.select(*pair).join(mine, [*STEP, name]).select(*pair, F.lit(is_new).alias("is_new"), (F.col("no") + 1).cast("long").alias("no"), "item")

    items = durable(side(False, "old_class").unionByName(side(True, "new_class")))
    sizes = items.groupBy(*pair).agg(F.count(F.lit(1)).alias("_all"))
    hits = match(items, pair).groupBy(*pair).agg(F.count(F.lit(1)).alias("_hits"))
    scored = sizes.join(hits, pair, "left").select(*pair, (2.0 * F.coalesce("_hits", F.lit(0)) / F.col("_all")).alias("ratio"))
    return scored.where(F.col("ratio") >= threshold)


# Pairs of small groups that one call assigns.
BUNDLE_PAIRS = 20_000


def _assign(keys: list[str], left: str, right: str, score: str):
    """Sequential greedy over the pairs of some whole groups of bounded size."""

    def run(pairs):
        import pyarrow.compute as pc

        order = pc.sort_indices(pairs, [(c, "descending") for c in (score, left, right)]).to_pylist()
        groups = list(zip(*[pairs.column(k).to_pylist() for k in keys]))
        lefts, rights = pairs.column(left).to_pylist(), pairs.column(right).to_pylist()
        used_left, used_right, kept = set(), set(), []
        for at in order:
            l, r = (groups[at], lefts[at]), (groups[at], rights[at])
            if l not in used_left and r not in used_right:
                used_left.add(l)
                used_right.add(r)
                kept.append(at)
        return pairs.select([*keys, left, right, score]).take(kept)

    return run


def _one_round(rest: DataFrame, keys: list[str], left: str, right: str, score: str) -> DataFrame:
    """Pairs that are the best of both their ends; bests are map-side combined aggregates."""
    best_left = rest.groupBy(*keys, left).agg(F.max(F.struct(score, right)).alias("_b")).select(
        *keys, left, F.col("_b")[right].alias(right), F.col("_b")[score].alias(score))
    best_right = rest.groupBy(*keys, right).agg(F.max(F.struct(score, left)).alias("_b")).select(
        *keys, right, F.col("_b")[left].alias(left))
    return best_left.join(best_right, [*keys, left, right])


def _block_pairs(rest: DataFrame, keys: list[str], left: str, right: str, score: str) -> DataFrame:
    """Pairs of complete blocks of equal best scores, by rank.

    Where some lefts all have the same rights at their best score, those rights have just these lefts at theirs,
    and the score is one for all, the one-by-one outcome pairs the k-th greatest left with the k-th greatest right.
    A neighbourhood is known by its size and two order-free digests, so none is gathered.
    """
    tops = [rest.groupBy(*keys, end).agg(F.max(score).alias(f"_{name}")) for end, name in ((left, "l"), (right, "r"))]
    edges = rest.join(tops[0], [*keys, left]).join(tops[1], [*keys, right]).select(
        *keys, left, right, score, (F.col(score) == F.col("_l")).alias("_of_l"), (F.col(score) == F.col("_r")).alias("_of_r"))
    # A best edge of one end that is not the other's best may come free later, so such ends are in no block.
    around = edges.where("_of_l").groupBy(*keys, left).agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64(right)).alias("_h"), F.bit_xor(F.xxhash64(right, F.lit(1))).alias("_g"), F.min("_of_r").alias("_own")).where("_own").drop("_own")
    degrees = edges.where("_of_r").groupBy(*keys, right).agg(F.count(F.lit(1)).alias("_d"), F.min("_of_l").alias("_own"))
    block = [*keys, "_n", "_h", "_g"]
    widths = around.groupBy(*block).agg(F.count(F.lit(1)).alias("_m"))
    inside = edges.where("_of_l AND _of_r").join(around, [*keys, left]).join(widths, block).join(degrees, [*keys, right])
    # Every right of a complete block has the block's lefts and no others.
    complete = inside.groupBy(*block, "_m").agg(F.min(F.col("_own") & (F.col("_d") == F.col("_m"))).alias("_all"), F.max(score).alias(score)).where("_all")
    members = inside.join(complete.select(*block), block, "left_semi")
    ends = [members.select(*block, end).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(*block).orderBy(F.col(end).desc()))) for end in (left, right)]
    return ends[0].join(ends[1], [*block, "_k"]).join(complete.select(*block, score), block).select(*keys, left, right, score)


def greedy_match(
    pairs: DataFrame, keys: list[str], left: str, right: str, score: str = "ratio",
    task_pairs: int = 200_000, stored: bool = False,
) -> DataFrame:
    """Strongest pair first, each end used once, ties by greater ``left`` then ``right``.

    Groups of at most ``task_pairs`` pairs are finished in a task, many small ones together in bundles of about
    ``BUNDLE_PAIRS`` pairs. A larger group first goes through rounds in which every pair that is the best of both
    its ends is taken, complete blocks of equal scores are paired by rank, and the
    ends retire; the order is total, so this is the one-by-one outcome, and no group
    above the bound ever meets in one task.
    Survivors of a round are checkpointed: a lost executor re-reads them.
    """
    columns = [*keys, left, right, score]
    rest = pairs.select(*columns) if stored else durable(pairs.select(*columns))
    schema = ", ".join(f"{n} {t}" for n, t in rest.dtypes)
    bundles = rest.count() // BUNDLE_PAIRS + rest.sparkSession.sparkContext.defaultParallelism

    def finish(groups: DataFrame) -> DataFrame:
        bundled = groups.withColumn("_bundle", F.pmod(F.xxhash64(*keys), F.lit(bundles)))
        return bundled.groupBy("_bundle").applyInArrow(_assign(keys, left, right, score), schema)

    done: list[DataFrame] = []
    while True:
        large = rest.groupBy(*keys).count().where(F.col("count") > task_pairs).select(*keys)
        if large.isEmpty():
            done.append(finish(rest))
            break
        done.append(finish(rest.join(large, keys, "left_anti")))
        rest = durable(rest.join(large, keys, "left_semi"))
        both = _one_round(rest, keys, left, right, score).select(*columns).unionByName(_block_pairs(rest, keys, left, right, score).select(*columns))
        hits = durable(both.distinct())
        done.append(hits)
        rest = durable(
            rest.join(hits.select(*keys, left), [*keys, left], "left_anti")
            .join(hits.select(*keys, right), [*keys, right], "left_anti"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def rename_nodes(leftovers: DataFrame, options: CompareOptions) -> DataFrame:
    """Added and removed text files worth comparing, without their text."""
    record = F.coalesce("new", "old")
    nodes = leftovers.select(
        *STEP, "path", (F.col("kind") == "added").alias("is_new"), record["sha256"].alias("sha256"),
        record["size"].alias("size"), record["lang"].alias("lang"),
        F.when(F.col("kind") == "added", F.col("new_seq")).otherwise(F.col("old_seq")).alias("seq"),
        record["is_text"].alias("_text"),
    ).where(F.col("_text") & (F.col("size") > 0)).drop("_text")
    if options.max_compare_bytes is not None:
        nodes = nodes.where(F.col("size") <= options.max_compare_bytes)
    family = paths.language_family(F.col("lang"))
    return nodes.withColumn("pair_key", paths.pair_key(F.col("path"), F.col("lang"))).withColumn(
        "family", F.when(family == "", F.col("lang")).otherwise(family))


def node_contents(nodes: DataFrame, files: DataFrame, whole: bool = False) -> DataFrame:
    """Line hashes, or the ``whole`` text, of each distinct content of the (stored) candidates; only their keys meet the text table."""
    one_each = durable(nodes.groupBy(*STEP, "is_new", "seq", "sha256").agg(F.min("path").alias("path")))
    texts, on = files.select("artifact", "seq", "path", "content"), ["artifact", "seq", "path"]
    if whole:
        return fetch(texts, one_each, on).select(*STEP, "is_new", "sha256", "content")
    return fetch_measured(texts, one_each, on, text.line_hashes(F.col("content"))).select(*STEP, "is_new", "sha256", "h", "h2")


PAIR = [*STEP, "new_path", "old_path"]


def _size_gate(old: Column, new: Column, options: CompareOptions) -> Column:
    return ((new + 1) / (old + 1)).between(options.min_size_ratio, options.max_size_ratio)


def _score(ratio: Column, same_key: Column, options: CompareOptions) -> Column:
    boosted = F.least(F.lit(1.0), ratio + options.rename_key_bonus)
    return F.round(F.when(same_key, boosted).otherwise(ratio), 6)


def path_pairs(scores: DataFrame, nodes: DataFrame, options: CompareOptions) -> DataFrame:
    """All admissible path pairs of the scored classes, written out one by one."""

    def side(is_new: bool, tag: str) -> DataFrame:
        names = {"class": f"{tag}_class", "path": f"{tag}_path", "size": f"{tag}_size", "pair_key": f"{tag}_key", "family": "family"}
        return nodes.where(F.col("is_new") == is_new).select(*STEP, *[F.col(a).alias(b) for a, b in names.items()])

    same_key = F.col("old_key") == F.col("new_key")
    joined = scores.join(side(False, "old"), [*STEP, "old_class"]).join(side(True, "new"), [*STEP, "new_class", "family"])
    return joined.where(_size_gate(F.col("old_size"), F.col("new_size"), options)).select(
        *PAIR, same_key.alias("same_key"), _score(F.col("ratio"), same_key, options).alias("ratio"))


def _handle(*parts: str) -> Column:
    return F.concat_ws("\x01", *[F.col(p).cast("string") if p in ("class", "family", "size", "pair_key") else F.lit(p) for p in parts])


KINDS = {"base": ("class", "family"), "base+size": ("class", "family", "size"), "key": ("class", "family", "pair_key"), "key+size": ("class", "family", "pair_key", "size")}


def pair_groups(scores: DataFrame, nodes: DataFrame, options: CompareOptions) -> DataFrame:
    """Complete groups of pairs: every member of one handle with every member of another.

    Columns: step, kind, old_handle, new_handle, ratio. A handle is a class, or a
    class under one pair key; it is cut by size only where the size gate admits some
    of the group's pairs and refuses others.
    """
    out = None
    for kind in ("base", "key"):
        cut = KINDS[kind]
        sums = nodes.groupBy(*STEP, "is_new", *cut).agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
        sizes = nodes.select(*STEP, "is_new", *cut, "size").distinct()
        on = [c for c in cut if c != "class"]

        def side(frame: DataFrame, is_new: bool, tag: str) -> DataFrame:
            rest = [c for c in frame.columns if c not in (*STEP, "is_new", "class", *on)]
            return frame.where(F.col("is_new") == is_new).select(
                *STEP, *on, F.col("class").alias(f"{tag}_class"), *[F.col(c).alias(f"{tag}_{c}") for c in rest])

        met = scores.join(side(sums, False, "old"), [*STEP, "old_class"]).join(side(sums, True, "new"), [*STEP, "new_class", *on])
        low, high = (F.col("new_lo") + 1) / (F.col("old_hi") + 1), (F.col("new_hi") + 1) / (F.col("old_lo") + 1)
        whole = (low >= options.min_size_ratio) & (high <= options.max_size_ratio)
        some = (high >= options.min_size_ratio) & (low <= options.max_size_ratio) & ~whole
        score = _score(F.col("ratio"), F.lit(kind == "key"), options).alias("ratio")

        def handle(tag: str, *parts: str) -> Column:
            named = [F.col(f"{tag}_{p}" if p in ("class", "size") else p).cast("string") for p in parts[1:]]
            return F.concat_ws("\x01", F.lit(parts[0]), *named).alias(f"{tag}_handle")

        full = met.where(whole).select(*STEP, F.lit(kind).alias("kind"), handle("old", kind, *cut), handle("new", kind, *cut), score)
        by_size = (
            met.where(some).select(*STEP, *on, "old_class", "new_class", "ratio")
            .join(side(sizes, False, "old"), [*STEP, "old_class", *on]).join(side(sizes, True, "new"), [*STEP, "new_class", *on])
            .where(_size_gate(F.col("old_size"), F.col("new_size"), options))
            .select(*STEP, F.lit(kind).alias("kind"), handle("old", f"{kind}+size", *cut, "size"), handle("new", f"{kind}+size", *cut, "size"), score)
        )
        part = full.unionByName(by_size)
        out = part if out is None else out.unionByName(part)
    return out


def banded_pairs(groups: DataFrame, members: DataFrame) -> DataFrame:
    """The path pairs of complete groups that the one-by-one rule can ever take.

    ``members``: step, is_new, kind, handle, path. Number the members of both sides of
    a group by path, greatest first. When the rule takes (r-th new, s-th old) of a
    group, all r-1 and s-1 greater members are gone already: k of each to this group,
    the others to groups scoring at least as high. So r-s lies within the number of
    members that have such another group, and only that band is written out. A lone
    pair of copy groups gives its diagonal: pairs grow with the copies, not their
    square.
    """
    numbered = durable(ordered(members, [*STEP, "is_new", "handle"], [F.col("path")], number="_up"))
    counts = numbered.groupBy(*STEP, "is_new", "handle").agg(F.count(F.lit(1)).alias("m"))
    placed = numbered.join(counts, [*STEP, "is_new", "handle"]).withColumn("at", F.col("m") - F.col("_up") + 1)

    def joined(is_new: bool, tag: str) -> DataFrame:
        side = placed.where(F.col("is_new") == is_new).select(*STEP, F.col("handle").alias(f"{tag}_handle"), "path", "at", "m")
        node = Window.partitionBy(*STEP, "path").orderBy(F.col("ratio").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return groups.join(side, [*STEP, f"{tag}_handle"]).withColumn("_elsewhere", (F.count(F.lit(1)).over(node) > 1).cast("bigint"))

    group = [*STEP, "old_handle", "new_handle", "ratio"]
    old, new = joined(False, "old"), joined(True, "new")
    slack = old.groupBy(*group).agg(F.sum("_elsewhere").alias("_y"), F.max("m").alias("_m")).join(
        new.groupBy(*group).agg(F.sum("_elsewhere").alias("_x")), group)
    reach = F.sequence(F.greatest(F.lit(1), F.col("at") - F.col("_x")), F.least(F.col("_m"), F.col("at") + F.col("_y")))
    inside = F.col("at") - F.col("_x") <= F.col("_m")
    wanted = new.join(slack, group).where(inside).select(*group, F.col("path").alias("new_path"), F.explode(reach).alias("at"))
    pairs = wanted.join(old.select(*group, F.col("path").alias("old_path"), "at"), [*group, "at"])
    return pairs.groupBy(*PAIR).agg(F.max("ratio").alias("ratio"))


def members_of(nodes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Each node under every handle it answers to."""
    handles = F.array(*[_handle(k, *KINDS[k]) for k in kinds])
    return nodes.select(*STEP, "is_new", "path", F.explode(handles).alias("handle"))


def similar_renames(
    leftovers: DataFrame, files: DataFrame, options: CompareOptions = CompareOptions(), ordered_ratio: bool = False,
    direct_pairs: int = 2_000_000, match: Callable[[DataFrame, list[str]], DataFrame] = aligned,
) -> DataFrame:
    """Pair added and removed files that look like one file, moved and edited.

    ``ordered_ratio`` scores by lines in order, matched by ``match``.
    Up to ``direct_pairs`` path pairs in all they are written out; beyond that only
    those the assignment can take (``banded_pairs``), with the same outcome.
    """
    found = durable(rename_nodes(leftovers, options))
    contents = node_contents(found, files, whole=ordered_ratio)
    classes, bag = content_classes(contents, by_content=ordered_ratio)
    scores = similar_classes(bag, options.rename_threshold)
    if ordered_ratio:
        scores = with_ordered_ratio(scores, contents, options.rename_threshold, match)
    scores = durable(scores.select(*STEP, "old_class", "new_class", "ratio"))
    nodes = durable(found.join(classes.drop("n"), [*STEP, "is_new", "sha256"]))
    sizes = nodes.groupBy(*STEP, "is_new", "class").agg(F.count(F.lit(1)).cast("double").alias("m"))
    old = sizes.where(~F.col("is_new")).select(*STEP, F.col("class").alias("old_class"), F.col("m").alias("_a"))
    new = sizes.where("is_new").select(*STEP, F.col("class").alias("new_class"), F.col("m").alias("_b"))
    total = scores.join(old, [*STEP, "old_class"]).join(new, [*STEP, "new_class"]).agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0.0))).first()[0]

    def open_only(rows: DataFrame, settled: DataFrame) -> DataFrame:
        return rows.join(settled.select(*STEP, "new_path"), [*STEP, "new_path"], "left_anti").join(
            settled.select(*STEP, "old_path"), [*STEP, "old_path"], "left_anti")

    # Same-name pairs alike enough are settled; their ends meet no other-name partner.
    if total <= direct_pairs:
        pairs = durable(path_pairs(scores, nodes, options))
        alike = pairs.where(F.col("same_key") & (F.col("ratio") >= options.rename_settled))
        settled = greedy_match(alike, STEP, "new_path", "old_path", stored=True)
        every = pairs.where("same_key").unionByName(open_only(pairs.where(~F.col("same_key")), settled))
        return greedy_match(every, STEP, "new_path", "old_path", stored=True)
    groups = durable(pair_groups(scores, nodes, options))
    by_key = groups.where(F.col("kind") == "key")
    keyed = members_of(nodes, ("key", "key+size"))
    alike = by_key.where(F.col("ratio") >= options.rename_settled).drop("kind")
    settled = durable(greedy_match(banded_pairs(alike, keyed), STEP, "new_path", "old_path"))
    gone = settled.select(*STEP, F.lit(True).alias("is_new"), F.col("new_path").alias("path")).unionByName(
        settled.select(*STEP, F.lit(False).alias("is_new"), F.col("old_path").alias("path")))
    still_open = members_of(nodes.join(gone, [*STEP, "is_new", "path"], "left_anti"), ("base", "base+size"))
    return greedy_match(banded_pairs(groups.drop("kind"), keyed.unionByName(still_open)), STEP, "new_path", "old_path")
