"""Sliced windows equal plain windows, however small the slices."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeledger.operators.ordered import SLICE, in_ranges, ordered


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(5)
    data = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(0, 900), f"src/lib/{rng.randrange(0, 500):03d}/x{i}.py", i, rng.randrange(1, 9)) for i in range(600)]
    return spark.createDataFrame(data, "k string, pos long, path string, id long, v long")


@pytest.mark.parametrize("by", ["pos", "path"])
@pytest.mark.parametrize("target", [7, 50, 10_000])
def test_same_as_plain_window(frame, by, target):
    order = [F.col(by), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    plain = frame.select("*", F.row_number().over(w).cast("bigint").alias("n"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("r"),
                         F.lag("id").over(w).alias("p"), F.lead("id").over(w).alias("f"))
    sliced = ordered(frame, ["k"], order, number="n", running={"r": "v"}, previous={"p": "id"}, following={"f": "id"}, target_rows=target)
    assert rows(sliced, "id", "n", "r", "p", "f") == rows(plain, "id", "n", "r", "p", "f")


def test_descending(frame):
    order = [F.col("pos").desc(), F.col("id")]
    plain = frame.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("bigint"))
    sliced = ordered(frame, ["k"], order, number="n", target_rows=9)
    assert rows(sliced, "id", "n") == rows(plain, "id", "n")


def test_few_values_are_cut_by_the_rest_of_the_order(spark):
    two = spark.range(10_000).select(F.lit("k").alias("k"), (F.col("id") % 2).alias("flag"), "id", F.lit(1).cast("long").alias("v"))
    order = [F.col("flag").desc(), F.col("id")]
    cut = in_ranges(two, ["k"], order, 20)
    assert max(r["n"] for r in cut.groupBy(SLICE).agg(F.count(F.lit(1)).alias("n")).collect()) <= 1000
    got = ordered(two, ["k"], order, number="n", running={"r": "v"}, target_rows=500)
    assert rows(got, "id", "n", "r") == sorted(((i, *([i // 2 + 1 + (0 if i % 2 else 5000)] * 2)) for i in range(10_000)), key=repr)


def test_null_keys_and_null_sums(spark):
    data = [(None if i % 2 else "a", i, None if i < 12 or i % 5 == 0 else i) for i in range(60)]
    df = spark.createDataFrame(data, "k string, id long, v long")
    w = Window.partitionBy("k").orderBy("id")
    plain = df.select("*", F.row_number().over(w).cast("bigint").alias("n"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("r"), F.lag("v").over(w).alias("p"))
    cut = ordered(df, ["k"], [F.col("id")], number="n", running={"r": "v"}, previous={"p": "v"}, target_rows=4)
    assert rows(cut, "id", "n", "r", "p") == rows(plain, "id", "n", "r", "p")


def test_empty_table(spark):
    assert rows(ordered(spark.createDataFrame([], "k string, id long"), ["k"], [F.col("id")], number="n", target_rows=4)) == []
