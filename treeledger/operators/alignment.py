"""Ordered matching of two sequences by anchors.

An anchor is an item that occurs once on each side. ``aligned`` keeps a longest run of anchors
in the same order on both sides, so a moved item costs only itself. From each anchor the match
runs on over equal neighbours: first forward, then backward through what is left before the
next anchor; the two ends of the sequences are anchors too. What is left of a gap is matched in
the same way again, by the items that occur once within it. The result is the same whichever
order the rows arrive in. A key's items meet in one task: they come from one text.

``matched`` states a narrower rule with windows and joins only, so one text of any length is shared
by many tasks: an anchor that any other anchor crosses is dropped, and gaps are not entered again;
``steady`` states that rule for two lists. The words of long lines are matched so. Where no anchors
cross and no gap has anchors of its own, both rules agree.

``row_script`` matches two sequences that lie on one row where they lie: nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

AT_ONCE = 10_000


def longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of ``pairs`` (rising in their first places) that rises in the second places too."""
    ends, at, before = [], [], []
    for k, (_, new) in enumerate(pairs):
        n = bisect_left(ends, new)
        before.append(at[n - 1] if n else -1)
        if n == len(ends):
            ends.append(new)
            at.append(k)
        else:
            ends[n], at[n] = new, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(old: list, new: list) -> list[tuple[int, int]]:
    """Matched places (from 0) of two sequences: anchors, runs from both ends of each gap, then the gaps' middles again."""
    out, todo = [], [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        olds, news = Counter(old[a:b]), Counter(new[c:d])
        where = {new[j]: j for j in range(c, d) if news[new[j]] == 1}
        anchors = longest_rising([(i, where[old[i]]) for i in range(a, b) if olds[old[i]] == 1 and old[i] in where])
        out += anchors
        for (i, j), (p, q) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            i, j = i + 1, j + 1
            while i < p and j < q and old[i] == new[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            while i < p and j < q and old[p - 1] == new[q - 1]:
                p, q = p - 1, q - 1
                out.append((p, q))
            if i < p and j < q and (i, p, j, q) != (a, b, c, d):
                todo.append((i, p, j, q))
    return out


def steady(old: list, new: list) -> list[tuple[int, int]]:
    """As ``align`` by the rule of ``matched``."""
    olds, news = Counter(old), Counter(new)
    where = {x: j for j, x in enumerate(new) if news[x] == 1}
    shared = [(i, where[x]) for i, x in enumerate(old) if olds[x] == 1 and x in where]
    before = accumulate((j for _, j in shared), max, initial=-1)
    after = [*accumulate((j for _, j in reversed(shared)), min, initial=len(new))][-2::-1]
    anchors = [(i, j) for (i, j), lo, hi in zip(shared, before, after) if lo < j < hi]
    out = list(anchors)
    for (i, j), (p, q) in zip([(-1, -1), *anchors], [*anchors, (len(old), len(new))]):
        i, j = i + 1, j + 1
        while i < p and j < q and old[i] == new[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and old[p - 1] == new[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
    return out


def script_of(old: list, new: list, match: Callable[[list, list], list[tuple[int, int]]] = align, context: int | None = None) -> Iterator[tuple]:
    """(place, gap, op, old_no, new_no, item) in reading order: kept items, and behind each what was deleted and then added.

    With ``context`` only rows at most so far from a change; places count all rows.
    """
    rows, i, j = [], 0, 0
    for p, q in [*sorted(match(old, new)), (len(old), len(new))]:
        rows += [(i, "del", k + 1, None, old[k]) for k in range(i, p)]
        rows += [(i, "add", None, k + 1, new[k]) for k in range(j, q)]
        if p < len(old):
            rows.append((i, "keep", p + 1, q + 1, old[p]))
        i, j = p + 1, q + 1
    if context is None:
        yield from ((n, *row) for n, row in enumerate(rows, 1))
        return
    done = 0
    for n, row in enumerate(rows):
        if row[1] != "keep":
            first = max(done, n - context)
            done = n + context + 1
            yield from ((k + 1, *rows[k]) for k in range(first, min(done, len(rows))))


def row_script(pairs: DataFrame, keys: list[str], old: Column, new: Column, match: Callable[[list, list], list[tuple[int, int]]] = align, context: int | None = None) -> DataFrame:
    """``script_of`` two arrays of strings on every row of ``pairs``: keys, place, gap, op, old_no, new_no, item."""
    kinds = dict(pairs.dtypes)
    own = "place bigint, gap bigint, op string, old_no bigint, new_no bigint, item string"

    def run(batches):
        import pyarrow as pa

        types = dict(zip(("place", "gap", "op", "old_no", "new_no", "item"), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())))

        def out(batch, at, rows):
            named = batch.select(keys).take(pa.array(at, pa.int64()))
            return pa.RecordBatch.from_arrays([*named.columns, *[pa.array(c, t) for c, t in zip(zip(*rows), types.values())]], [*keys, *types])

        for batch in batches:
            at, rows = [], []
            for k, (a, b) in enumerate(zip(batch.column("_old"), batch.column("_new"))):
                for row in script_of(a.as_py() or [], b.as_py() or [], match, context):
                    at.append(k)
                    rows.append(row)
                    if len(rows) == AT_ONCE:
                        yield out(batch, at, rows)
                        at, rows = [], []
            if rows:
                yield out(batch, at, rows)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), own])
    return pairs.select(*keys, old.alias("_old"), new.alias("_new")).mapInArrow(run, schema)


def aligned(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old_no, new_no) of matched items. ``items``: keys, is_new, no (from 1 without gaps), item."""
    kinds = dict(items.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no")
        old, new = (rows.loc[rows["is_new"] == side, "item"].tolist() for side in (False, True))
        pairs = sorted(align(old, new))
        places = {"old_no": [i + 1 for i, _ in pairs], "new_no": [j + 1 for _, j in pairs]}
        return pd.DataFrame({**{k: [rows[k].iloc[0]] * len(pairs) for k in keys}, **places}, dtype=object)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "old_no bigint", "new_no bigint"])
    return items.select(*keys, "is_new", "no", "item").groupBy(*keys).applyInPandas(run, schema)


def matched(items: DataFrame, keys: list[str]) -> DataFrame:
    """As ``aligned``, but only with anchors that no other crosses, and without entering gaps again."""
    once = items.groupBy(*keys, "item").agg(
        F.sum((~F.col("is_new")).cast("long")).alias("olds"), F.sum(F.col("is_new").cast("long")).alias("news"),
        F.max(F.when(~F.col("is_new"), F.col("no"))).alias("old_no"), F.max(F.when(F.col("is_new"), F.col("no"))).alias("new_no"))
    shared = once.where("olds = 1 and news = 1").select(*keys, "old_no", "new_no")
    along = Window.partitionBy(*keys).orderBy("old_no")
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    steady = shared.withColumn("lo", F.max("new_no").over(before)).withColumn("hi", F.min("new_no").over(after)).where(
        (F.coalesce("lo", F.lit(0)) < F.col("new_no")) & (F.col("hi").isNull() | (F.col("new_no") < F.col("hi")))).select(*keys, "old_no", "new_no")
    sizes = items.groupBy(*keys).agg(
        F.sum((~F.col("is_new")).cast("long")).alias("olds"), F.sum(F.col("is_new").cast("long")).alias("news"))
    marks = steady.unionByName(sizes.select(*keys, F.lit(0).cast("long").alias("old_no"), F.lit(0).cast("long").alias("new_no"))).unionByName(
        sizes.select(*keys, (F.col("olds") + 1).alias("old_no"), (F.col("news") + 1).alias("new_no")))
    gaps = marks.withColumn("old_end", F.lead("old_no").over(along)).withColumn("new_end", F.lead("new_no").over(along)).where("old_end is not null").select(
        *keys, F.col("old_no").alias("old_start"), F.col("new_no").alias("new_start"), "old_end", "new_end",
        F.least(F.col("old_end") - F.col("old_no"), F.col("new_end") - F.col("new_no")).alias("room"))
    open_ = gaps.where("room > 1")
    old, new = (items.where(F.col("is_new") == side).select(*keys, "no", "item") for side in (False, True))

    def run(forward: bool) -> DataFrame:
        """How many neighbours match from one end of each gap."""
        step = F.explode(F.sequence(F.lit(1).cast("long"), F.col("room") - 1))
        pairs = open_.select(*keys, "old_start", "new_start", "old_end", "new_end", step.alias("k"))
        at = ("old_start", "new_start", 1) if forward else ("old_end", "new_end", -1)
        pairs = pairs.select(*keys, "old_start", "k", (F.col(at[0]) + at[2] * F.col("k")).alias("a"), (F.col(at[1]) + at[2] * F.col("k")).alias("b"))
        both = pairs.join(old.withColumnRenamed("no", "a").withColumnRenamed("item", "x"), [*keys, "a"]).join(
            new.withColumnRenamed("no", "b").withColumnRenamed("item", "y"), [*keys, "b"])
        first = F.min(F.when(F.col("x") != F.col("y"), F.col("k")))
        return both.groupBy(*keys, "old_start").agg((F.coalesce(first, F.max("k") + 1) - 1).alias("ahead" if forward else "back"))

    runs = gaps.join(run(True), [*keys, "old_start"], "left").join(run(False), [*keys, "old_start"], "left").withColumn("ahead", F.coalesce("ahead", F.lit(0))).withColumn(
        "back", F.least(F.coalesce("back", F.lit(0)), F.col("room") - 1 - F.col("ahead")))
    none = F.array().cast("array<bigint>")

    def counted(n):
        return F.when(F.col(n) > 0, F.sequence(F.lit(1).cast("long"), F.col(n))).otherwise(none)

    steps = F.concat(
        F.transform(counted("ahead"), lambda k: F.struct((F.col("old_start") + k).alias("old_no"), (F.col("new_start") + k).alias("new_no"))),
        F.transform(counted("back"), lambda k: F.struct((F.col("old_end") - k).alias("old_no"), (F.col("new_end") - k).alias("new_no"))))
    return steady.unionByName(runs.select(*keys, F.explode(steps).alias("s")).select(*keys, "s.old_no", "s.new_no"))


def edit_script(items: DataFrame, keys: list[str], match: Callable[[DataFrame, list[str]], DataFrame] = aligned) -> DataFrame:
    """(keys, gap, op, old_no, new_no, item): kept, deleted and added items; ``gap`` is the old number of the last kept item before, 0 at the start."""
    items = durable(items)
    pairs = durable(match(items, keys))
    old = items.where("not is_new").select(*keys, F.col("no").alias("old_no"), "item").join(pairs, [*keys, "old_no"], "left")
    new = items.where("is_new").select(*keys, F.col("no").alias("new_no"), "item").join(pairs, [*keys, "new_no"], "left").where("old_no is null")
    op = F.when(F.col("new_no").isNull(), "del").otherwise("keep")
    by_old = Window.partitionBy(*keys).orderBy("old_no").rowsBetween(Window.unboundedPreceding, -1)
    olds = old.withColumn("op", op).withColumn("gap", F.coalesce(F.max(F.when(F.col("op") == "keep", F.col("old_no"))).over(by_old), F.lit(0).cast("long")))
    kept = olds.where("op = 'keep'").select(*keys, F.col("new_no").alias("no_"), F.col("old_no").alias("last_"), F.lit(False).alias("added_"), F.lit(None).cast("string").alias("item"))
    adds = new.select(*keys, F.col("new_no").alias("no_"), F.lit(None).cast("long").alias("last_"), F.lit(True).alias("added_"), "item").unionByName(kept)
    by_new = Window.partitionBy(*keys).orderBy("no_").rowsBetween(Window.unboundedPreceding, -1)
    added = adds.withColumn("gap", F.coalesce(F.max("last_").over(by_new), F.lit(0).cast("long"))).where("added_").select(
        *keys, "gap", F.lit("add").alias("op"), F.lit(None).cast("long").alias("old_no"), F.col("no_").alias("new_no"), "item")
    return olds.select(*keys, "gap", "op", "old_no", "new_no", "item").unionByName(added)


def sql_matched(items: str, keys: str, p: str = "") -> str:
    """CTEs ending in ``{p}matched`` that state the same over a relation (keys, is_new, no, item)."""
    same = " AND ".join(f"g.{k} = {{0}}.{k}" for k in keys.split(", "))
    def run(name, a, b):
        return f"""
{p}{name} AS (SELECT {', '.join('g.' + k for k in keys.split(', '))}, g.old_start, coalesce(min(k) FILTER (x.item <> y.item), max(k) + 1) - 1 AS n FROM (SELECT *, unnest(range(1, room)) AS k FROM {p}gaps) g
  JOIN {items} x ON {same.format('x')} AND NOT x.is_new AND x.no = {a} JOIN {items} y ON {same.format('y')} AND y.is_new AND y.no = {b} GROUP BY ALL)"""
    on = " AND ".join(f"g.{k} = {{0}}.{k}" for k in [*keys.split(", "), "old_start"])
    return f"""
{p}shared AS (SELECT {keys}, max(no) FILTER (NOT is_new) AS old_no, max(no) FILTER (is_new) AS new_no FROM {items} GROUP BY {keys}, item HAVING count(*) = 2 AND count(*) FILTER (is_new) = 1),
{p}steady AS (SELECT {keys}, old_no, new_no FROM (SELECT *, max(new_no) OVER (PARTITION BY {keys} ORDER BY old_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
  min(new_no) OVER (PARTITION BY {keys} ORDER BY old_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM {p}shared) WHERE coalesce(lo, 0) < new_no AND (hi IS NULL OR new_no < hi)),
{p}marks AS (SELECT * FROM {p}steady UNION ALL SELECT DISTINCT {keys}, 0, 0 FROM {items}
  UNION ALL SELECT {keys}, count(*) FILTER (NOT is_new) + 1, count(*) FILTER (is_new) + 1 FROM {items} GROUP BY {keys}),
{p}gaps AS (SELECT *, least(old_end - old_start, new_end - new_start) AS room FROM (SELECT {keys}, old_no AS old_start, new_no AS new_start, lead(old_no) OVER w AS old_end, lead(new_no) OVER w AS new_end
  FROM {p}marks WINDOW w AS (PARTITION BY {keys} ORDER BY old_no)) WHERE old_end IS NOT NULL),
{run('ahead', 'old_start + k', 'new_start + k')},
{run('behind', 'old_end - k', 'new_end - k')},
{p}runs AS (SELECT g.*, coalesce(a.n, 0) AS af, least(coalesce(b.n, 0), room - 1 - coalesce(a.n, 0)) AS bf FROM {p}gaps g LEFT JOIN {p}ahead a ON {on.format('a')} LEFT JOIN {p}behind b ON {on.format('b')}),
{p}matched AS (SELECT * FROM {p}steady UNION ALL SELECT {keys}, old_start + k, new_start + k FROM (SELECT *, unnest(range(1, af + 1)) AS k FROM {p}runs)
  UNION ALL SELECT {keys}, old_end - k, new_end - k FROM (SELECT *, unnest(range(1, bf + 1)) AS k FROM {p}runs))"""


def sql_script(items: str, keys: str, p: str = "") -> str:
    """CTEs ending in ``{p}script``: keys, gap, op, old_no, new_no, item."""
    using = keys.replace(", ", ", ")
    return f"""{sql_matched(items, keys, p)},
{p}olds AS (SELECT {keys}, old_no, new_no, item FROM (SELECT {keys}, no AS old_no, item FROM {items} WHERE NOT is_new) LEFT JOIN {p}matched USING ({using}, old_no)),
{p}news AS (SELECT {keys}, old_no, new_no, item FROM (SELECT {keys}, no AS new_no, item FROM {items} WHERE is_new) LEFT JOIN {p}matched USING ({using}, new_no)),
{p}script AS (SELECT {keys}, coalesce(max(CASE WHEN new_no IS NOT NULL THEN old_no END) OVER (PARTITION BY {keys} ORDER BY old_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap,
    CASE WHEN new_no IS NULL THEN 'del' ELSE 'keep' END AS op, old_no, new_no, item FROM {p}olds
  UNION ALL SELECT {keys}, gap, 'add', NULL, new_no, item FROM (SELECT *, coalesce(max(old_no) OVER (PARTITION BY {keys} ORDER BY new_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM {p}news) WHERE old_no IS NULL)"""
