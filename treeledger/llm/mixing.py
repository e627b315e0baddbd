"""Sources mixed to target weights by Poisson replication.

Each source gets a mean repetition rate, its target rows over its rows. A row's number of
copies inverts the Poisson distribution of that mean at a uniform number drawn from a
seeded digest of its id, so the choice depends on the row alone: no counters, no order.
Copies are exploded and shuffled globally by a second digest.

``weights`` names target weights of sources (any others get ``other``); without it a
source of n rows weighs n ** ``temper``. Rates above ``PART`` are split into several
draws of equal mean, whose sum has the same distribution, so large rates do not underflow.

A null source is a source of its own, a null doc_id draws as the word null; rows that
repeat a doc_id draw alike; null texts count as rows; an empty table gives no rows; extra
columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.columns import veiled
from treeledger.llm.ranks import leading, number, seeded, seeded_sql
from treeledger.llm.registry import query
from treeledger.operators.durable import durable, fetch
from treeledger.sources.adapters import table

SEED = 11
TEMPER = 0.5
PART = 256.0


def source_key() -> Column:
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, temper: float = TEMPER, other: float = 0.0) -> DataFrame:
    """stratum_, rows_, rate_ (mean copies of each row) per source."""
    sizes = docs.groupBy(source_key().alias("stratum_")).agg(F.count(F.lit(1)).alias("rows_"))
    weight = F.pow("rows_", F.lit(float(temper)))
    if weights is not None:
        weight = F.lit(float(other))
        for name, value in weights.items():
            weight = F.when(F.col("stratum_") == "s" + name, float(value)).otherwise(weight)
    sizes = durable(sizes.withColumn("weight_", weight))
    sums = sizes.agg(F.sum("rows_").alias("n"), F.sum("weight_").alias("w")).first()
    wanted = float(total if total is not None else sums.n or 0)
    share = F.col("weight_") / F.lit(float(sums.w or 1.0))
    return durable(sizes.select("stratum_", "rows_", (F.lit(wanted) * share / F.col("rows_")).alias("rate_")))


def with_steps(rates: DataFrame) -> DataFrame:
    """Adds draws_ and steps_: the cumulative Poisson probabilities of one draw, as far as they matter."""
    per_draw = F.col("rate_") / F.col("draws_")
    last = F.ceil(per_draw + 12 * F.sqrt(per_draw) + 24).cast("int")
    start = F.struct(F.exp(-per_draw).alias("p"), F.exp(-per_draw).alias("c"), F.array(F.exp(-per_draw)).alias("all"))

    def step(acc, k):
        p = acc["p"] * per_draw / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.array_append(acc["all"], acc["c"] + p).alias("all"))

    return rates.withColumn("draws_", F.greatest(F.lit(1), F.ceil(F.col("rate_") / PART)).cast("int")).withColumn(
        "steps_", F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])
    )


def uniform(seed: int, *parts) -> Column:
    """A multiple of 2 ** -52 in [0, 1)."""
    return F.conv(F.substring(seeded(seed, *parts), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def poisson_copies(docs: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` once per copy, with ``copy_`` (from 0) and ``key_``, the shuffling digest."""
    drawn = F.aggregate(
        F.sequence(F.lit(0), F.col("draws_") - 1), F.lit(0),
        lambda acc, i: acc + F.size(F.filter("steps_", lambda c: c <= uniform(seed, "doc_id", i))),
    )
    counted = fetch(docs.withColumn("stratum_", source_key()), with_steps(rates), ["stratum_"]).withColumn("copies_", drawn)
    return (
        counted.where("copies_ > 0")
        .withColumn("copy_", F.explode(F.sequence(F.lit(0), F.col("copies_") - 1)))
        .withColumn("key_", seeded(seed + 1, "doc_id", "copy_"))
        .drop("stratum_", "rows_", "rate_", "draws_", "steps_", "copies_")
    )


def mixed(docs: DataFrame, seed: int = SEED, **target) -> DataFrame:
    """The mixed corpus in its shuffled order, with the columns of ``docs``."""
    rows = veiled(docs, "doc_id", "source")
    return poisson_copies(rows, source_rates(rows, **target), seed).orderBy("key_").select(*rows.columns).toDF(*docs.columns)


MIX_SQL = f"""
WITH sized AS (
  SELECT CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS stratum, count(*) AS n FROM documents GROUP BY 1
),
rated AS (
  SELECT stratum, (SELECT sum(n) FROM sized) * (sqrt(n) / (SELECT sum(sqrt(n)) FROM sized)) / n AS rate FROM sized
),
parts AS (SELECT stratum, rate, greatest(1, CAST(ceil(rate / {PART}) AS INTEGER)) AS draws FROM rated),
terms AS (
  SELECT stratum, unnest(range(0, CAST(ceil(rate / draws + 12 * sqrt(rate / draws) + 24) AS BIGINT) + 1)) AS j, rate / draws AS m FROM parts
),
steps AS (
  SELECT stratum, j, sum(exp(-m + j * ln(m) - lgamma(j + 1))) OVER (PARTITION BY stratum ORDER BY j) AS c FROM terms
),
lists AS (SELECT stratum, list(c ORDER BY j) AS cs FROM steps GROUP BY stratum),
drawn AS (
  SELECT doc_id, source, list_sum(list_transform(range(draws), lambda i: len(list_filter(cs, lambda c: c <=
    CAST('0x' || substr({seeded_sql(SEED, "doc_id", "i")}, 1, 13) AS BIGINT) / 4503599627370496.0))))::INTEGER AS copies
  FROM documents d JOIN parts p ON p.stratum = CASE WHEN d.source IS NULL THEN 'n' ELSE 's' || d.source END JOIN lists USING (stratum)
),
exploded AS (SELECT doc_id, source, CAST(unnest(range(copies)) AS INTEGER) AS copy FROM drawn)
SELECT doc_id, source, copy, row_number() OVER (ORDER BY {seeded_sql(SEED + 1, "doc_id", "copy")}, doc_id, copy) - 1 AS position FROM exploded
"""


@query("op1_poisson_mix", MIX_SQL)
def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which copies of which document the mixture takes, and each copy's place in the global shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    copies = poisson_copies(docs, source_rates(docs))
    order = [F.col("key_"), F.col("doc_id"), F.col("copy_")]
    return number(copies, leading(F.col("key_")), order, (), "position", "all_").select("doc_id", "source", F.col("copy_").alias("copy"), "position")
