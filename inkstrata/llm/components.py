"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.llm.common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that is not the least of its component.

    edges has long columns u and v. Large-star and small-star steps alternate
    until every edge points at the least node of its component; each round is a
    fixed number of shuffles of the edges and nothing is gathered on the driver.
    """
    def nearest(pairs: DataFrame) -> DataFrame:
        """pairs with m, the least v of each u: partial minima before the shuffle, so that no task gathers a hub's edges."""
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")

    now = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = nearest(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = nearest(cut_lineage(large))
        out = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        now = cut_lineage(out)
        roots = now.select(F.col("v").alias("u")).distinct()
        unsettled = now.groupBy("u").count().where("count > 1").select("u").unionByName(now.select("u").join(roots, "u", "left_semi"))
        if unsettled.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
