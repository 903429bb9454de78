"""Connected components of a link table, by alternating stars.

Every link is turned towards the smallest neighbour of its ends: first each node passes its
smallest neighbour to its larger ones, then to its smaller ones, until nothing changes; all
nodes of a component then hang on its smallest. The rounds grow with the logarithm of the
longest path. Minima combine before they shuffle; links are never gathered by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caselens.scratch import write_and_reread


def _towards_smallest(directed: DataFrame) -> DataFrame:
    """``directed`` (u, v): u with its neighbours; adds m, the smallest of them and u."""
    smallest = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(smallest, "u")


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """``node``, ``component`` for all nodes with a link; a component is named by its smallest node."""
    a, b = F.col(first), F.col(second)
    edges = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = write_and_reread(edges, "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        stars = _towards_smallest(large)
        small = stars.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(stars.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = write_and_reread(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
