"""Connected components of a link table, by label passing and label jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.operators.durable import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node it reaches) for the nodes of ``links`` (a, b: long).

    Each round takes the least label of the neighbours and then the label of that label,
    so long chains shrink geometrically. Labels are stored once a round; a node with very
    many links is combined before the shuffle.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"), F.lit(True).alias("moved")))
    while True:
        told = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("told"))
        heard = labels.join(told.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "told").alias("near"))
        beyond = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        least = F.least("near", "far")
        labels = stored(heard.join(beyond, "near").select("node", least.alias("component"), (least < F.col("old")).alias("moved")), labels)
        if labels.where("moved").isEmpty():
            return labels.select("node", "component")
