"""Gapless numbers over groups of any size, with DataFrame functions only.

Rows are dealt to (group, slice), where slices follow the order. Counts per slice give
each slice its first number; inside a slice a plain window numbers the rows. A group
that holds a third of all rows is spread over all slices, and no task sees more than one
slice of it at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 4096


def number(df: DataFrame, piece: Column, order: list[Column], groups: tuple[str, ...] = (), out: str = "rank_", total: str = "total_") -> DataFrame:
    """Adds ``out`` (0, 1, ... in ``order`` within ``groups``) and ``total`` (rows of the group).

    ``piece`` is an integer from 0 to ``SLICES - 1`` that never falls along ``order``.
    ``groups`` hold no nulls. Rows equal in the whole order get their numbers in any order.
    """
    cut = df.withColumn("piece_", piece.cast("int"))
    counts = cut.groupBy(*groups, "piece_").agg(F.count(F.lit(1)).alias("in_piece_"))
    along = Window.partitionBy(*groups).orderBy("piece_")
    starts = counts.select(
        *groups, "piece_", (F.sum("in_piece_").over(along) - F.col("in_piece_")).alias("before_"),
        F.sum("in_piece_").over(Window.partitionBy(*groups)).alias(total),
    )
    inside = Window.partitionBy(*groups, "piece_").orderBy(*order)
    return (
        cut.join(starts, [*groups, "piece_"])
        .withColumn(out, F.row_number().over(inside) - 1 + F.col("before_"))
        .drop("piece_", "before_")
    )


def seeded(seed: int, *parts: str | Column) -> Column:
    """32 hex digits drawn from the seed and the parts; a null part counts as the word null."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *texts))


def seeded_sql(seed: int, *parts: str) -> str:
    return "md5(" + " || ':' || ".join([f"'{seed}'", *(f"coalesce(CAST({p} AS VARCHAR), 'null')" for p in parts)]) + ")"


def leading(key: Column) -> Column:
    """The first three hex digits as a number below ``SLICES``."""
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")
