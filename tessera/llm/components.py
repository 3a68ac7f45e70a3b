"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of integers to node, component: every node of a link with the smallest node that it reaches.

    Every step keeps the components and shortens the paths; it ends when a step changes nothing. No step
    gathers a node's neighbours in one row: the minimum is aggregated before the shuffle, and joins on a node
    with many links can be split. Links of a node to itself and nulls are ignored.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = stored(links.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = edges.join(least, edges.b == least.n).where("a <> m").select("a", F.col("m").alias("b")).distinct()
        # above: larger neighbours go to the minimum of a node; below: a node and its smaller neighbours do
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(down, large.a == down.n)
        steps = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        new = stored(steps, "links")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.count_distinct("a")).first()
        dropped(edges)
        edges = new
        if tuple(now) == mark or not now[0]:
            break
        mark = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select("b", "b").toDF("node", "component").distinct())
