"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsight.llm.common import landed


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node that has a link, with the smallest node it can reach.

    Each step links nodes to the smallest of their neighbourhood; the steps needed grow with the logarithm of the number
    of nodes. Each step's link table is written to the cluster's shared folder, which ends its lineage; only counts go to
    the driver. Links with a null end are dropped.
    """
    low, high = F.least(a, b).alias("low"), F.greatest(a, b).alias("high")
    both_ends = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    links = landed(both_ends.select(low, high).filter("low < high").distinct(), "components")
    while True:
        # Large star: each node's larger neighbours are linked to the smallest of itself and its neighbours.
        both = links.union(links.select("high", "low")).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("least", "node").alias("root"))
        large = both.filter("other > node").join(least, "node").select(F.col("root").alias("low"), F.col("other").alias("high")).distinct()
        # Small star: each node's smaller neighbours, and the node, are linked to the smallest of them.
        least = large.groupBy("high").agg(F.min("low").alias("root"))
        joined = large.join(least, "high")
        small = joined.select(F.col("root").alias("low"), F.col("low").alias("high")).union(joined.select("root", "high"))
        after = landed(small.filter("low < high").distinct(), "components")
        if after.count() == links.count() and links.join(after, ["low", "high"], "left_anti").isEmpty():
            return links.select(F.col("high").alias("node"), F.col("low").alias("root")).union(links.select("low", "low").distinct())
        links = after
