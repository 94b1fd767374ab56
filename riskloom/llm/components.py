"""Connected components of a distributed list of links, by alternating large and small stars.

Rows stay in the cluster; the driver only learns each round whether all links are stars by now. The number of
rounds grows with the logarithm of the longest path. Hot nodes (a star whose middle has a third
of all links) are safe: their smallest neighbour is found by partial aggregation, and the join
that spreads it reads stashed tables, whose large partitions AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free, stash


def _settled(pairs: DataFrame) -> bool:
    """Whether the pairs are stars: no node has two smaller ends, and none that has one is one."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    ends = both.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("middle"))
    return ends.filter("ups > 1 OR (ups = 1 AND middle = 0)").isEmpty()


def _large(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stash(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    found = stash(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
    free(least)
    return found


def _small(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Here u > v in each pair."""
    least = stash(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    down = pairs.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    found = stash(down.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small")
    free(least)
    return found


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for each node that stands in a link of two nodes.

    The result is a stashed table, which the caller may free.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    pairs = stash(pairs, "links")
    while not _settled(pairs):
        large = _large(pairs)
        small = _small(large)
        free(pairs, large)
        pairs = small
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    found = stash(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    free(pairs)
    return found
