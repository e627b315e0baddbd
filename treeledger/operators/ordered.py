"""Ordered work inside groups of any size: numbers, running sums, neighbours.

A plain ``Window.partitionBy(key)`` sends a whole group through one task. Where a
group is larger than ``target_rows``, the rows are instead dealt into ranges of
(keys, full order), each range is windowed on its own, and what a range needs from
the earlier ones of its group (how many rows, which sum, which last value) comes from
a summary of one row per group and range. The ranges follow the whole order, so a
first order column with few values is cut like any other; only rows that are equal in
every order column stay together. Results equal the plain window. The largest group
is counted first, over the key columns alone; when it is within the target, which is
usual, the plan is exactly the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .durable import durable

TARGET_ROWS = 500_000
SLICE = "_slice"


def in_ranges(df: DataFrame, keys: list[str], order: list[Column], pieces: int) -> DataFrame:
    """Stored rows with the number of their range of (keys, order).

    Spark samples the order to place the bounds. The numbers are stored with the rows,
    since another evaluation could place the bounds elsewhere.
    """
    dealt = df.repartitionByRange(pieces, *[F.col(k) for k in keys], *order)
    return durable(dealt.withColumn(SLICE, F.spark_partition_id()))


def _plain(df: DataFrame, keys: list[str], order: list[Column], number: str | None, running: dict, previous: dict, following: dict) -> DataFrame:
    """The same results by one window per group."""
    group = Window.partitionBy(*keys).orderBy(*order)
    upto = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {n: F.sum(c).over(upto) for n, c in running.items()}
    columns |= {n: F.lag(c).over(group) for n, c in previous.items()} | {n: F.lead(c).over(group) for n, c in following.items()}
    if number:
        columns[number] = F.row_number().over(group).cast("bigint")
    return df.select("*", *[c.alias(n) for n, c in columns.items()])


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    *,
    number: str | None = None,
    running: dict[str, str] | None = None,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Window results per group, whatever the group's size.

    ``number`` names a 1-based row number, ``running`` maps output to a summed column
    (inclusive), ``previous``/``following`` map output to the neighbour's column. A null
    key is a group like any other.
    """
    running, previous, following = running or {}, previous or {}, following or {}
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("largest"), F.sum("_n").alias("rows")).first()
    if (sizes.largest or 0) <= target_rows:
        return _plain(df, keys, order, number, running, previous, following)
    sliced = in_ranges(df, keys, order, -(-sizes.rows // target_rows))
    inner = Window.partitionBy(*keys, SLICE).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sliced.withColumn("_rn", F.row_number().over(inner))
    for name, column in running.items():
        out = out.withColumn(name, F.sum(column).over(upto))
    for name, column in previous.items():
        out = out.withColumn(name, F.lag(column).over(inner))
    for name, column in following.items():
        out = out.withColumn(name, F.lead(column).over(inner))
    if following:
        out = out.withColumn("_last", F.lead(F.lit(1)).over(inner).isNull())

    # One row per group and range: what the next ranges of the group need.
    carries: list[Column] = [F.count(F.lit(1)).alias("_c_n")]
    carries += [F.sum(c).alias(f"_c_r_{n}") for n, c in running.items()]
    carries += [F.max_by(c, "_rn").alias(f"_c_p_{n}") for n, c in previous.items()]
    carries += [F.min_by(c, "_rn").alias(f"_c_f_{n}") for n, c in following.items()]
    summary = out.groupBy(*keys, SLICE).agg(*carries)
    across = Window.partitionBy(*keys).orderBy(SLICE)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    picked: list[Column] = [F.sum("_c_n").over(before).alias("_b_n")]
    picked += [F.sum(f"_c_r_{n}").over(before).alias(f"_b_r_{n}") for n in running]
    picked += [F.lag(f"_c_p_{n}").over(across).alias(f"_b_p_{n}") for n in previous]
    picked += [F.lead(f"_c_f_{n}").over(across).alias(f"_b_f_{n}") for n in following]
    carry = summary.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(SLICE).alias("_k_slice"), *picked)

    same = F.col(SLICE) == F.col("_k_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = out.join(carry, same, "left")
    if number:
        out = out.withColumn(number, (F.col("_rn") + F.coalesce(F.col("_b_n"), F.lit(0))).cast("bigint"))
    for name in running:
        carried, own = F.col(f"_b_r_{name}"), F.col(name)
        out = out.withColumn(name, F.coalesce(own + carried, own, carried))
    for name in previous:
        out = out.withColumn(name, F.when(F.col("_rn") == 1, F.col(f"_b_p_{name}")).otherwise(F.col(name)))
    for name in following:
        out = out.withColumn(name, F.when(F.col("_last"), F.col(f"_b_f_{name}")).otherwise(F.col(name)))
    return out.select(*df.columns, *[n for n in (number,) if n], *running, *previous, *following)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, number: str = "rank") -> DataFrame:
    """First ``n`` rows per group. Spark limits each partition to ``n`` per key before
    the shuffle (window group limit), so a hot group never travels whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(number, F.row_number().over(w)).where(F.col(number) <= n)
