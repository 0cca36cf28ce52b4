"""Connected components by alternating large-star and small-star steps, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Every node of ``links`` (two long columns) with the smallest node that it reaches: columns ``node``, ``root``.

    ``links`` is read again at the end, so it should be a written table. Each step rewires a node's neighbours to the smallest of them, which keeps the components and halves distances, so
    rounds grow with the logarithm of the longest path. A node's smallest neighbour is found by an aggregate with
    map-side combine, not by gathering its neighbours, so hubs are no hot groups. Links of a node to itself, nulls and
    repeated links have no effect (a node known from a self-link alone is its own root).
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    nodes = both.select("u").union(both.select("v")).distinct()
    edges = stash(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        two_way = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two_way.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = two_way.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = stash(small.where("u <> v").distinct())
        # stars only: every node with a smaller neighbour has one, and no centre has a smaller neighbour itself
        tops = after.groupBy("u").agg(F.count("*").alias("n"))
        open_ends = after.join(tops.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() + tops.where("n > 1").limit(1).count()
        edges = after
        if not open_ends:
            break
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    return nodes.join(edges.withColumnRenamed("u", "node"), nodes.u == F.col("node"), "left").select(nodes.u.alias("node"), F.coalesce("v", nodes.u).alias("root"))
