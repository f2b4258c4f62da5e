"""Connected components of a graph that is held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewire.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``edges``; the root is the smallest node of its component.

    Alternates two steps until nothing changes: every node ties its larger neighbours to the smallest of its
    neighbourhood, then its smaller ones. The number of rounds grows with the logarithm of the number of nodes; minima
    are combined before the shuffle, so a node with very many neighbours is no burden."""
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links = materialize(links, "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u > v").distinct()
        large = materialize(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "links")
        # Done when every node hangs on a root: a star is left as it is by both steps.
        more = small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() or small.groupBy(
            "u").count().where("count > 1").limit(1).count()
        links = small
        if not more:
            break
    roots = links.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    own = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return materialize(roots.unionByName(own), "roots")
