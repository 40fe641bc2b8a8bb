"""Connected components by alternating large-star and small-star, as joins and grouped minima.

Published method: Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii: Connected Components in MapReduce and
Beyond (SoCC 2014). A neighbourhood is never gathered into one row: each star is a grouped minimum (combined
before the shuffle) and an equi-join, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexvane.llm.common import materialise, remove


def _large_star(edges: DataFrame) -> DataFrame:
    """edges: (big, small), big > small. Joins every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select(F.col("big").alias("node"), F.col("small").alias("least")).unionByName(edges.select(F.col("small").alias("node"), F.col("small").alias("least")))
    least = both.groupBy("node").agg(F.min("least").alias("least"))
    return edges.join(least, edges.small == least.node).select("big", F.col("least").alias("small")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the least of these."""
    least = edges.groupBy("big").agg(F.min("small").alias("least"))
    moved = edges.join(least, "big").filter(F.col("small") > F.col("least")).select(F.col("small").alias("big"), F.col("least").alias("small"))
    return moved.unionByName(least.select("big", F.col("least").alias("small"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("big", "small").cast("decimal(20,0)")), F.lit(0))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (src, dst): component is the least node that can be reached.

    Ids are of one orderable type. Null ends, loops, repeated and reversed edges change nothing; without edges
    the result is empty. Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    a, b = F.col("src"), F.col("dst")
    now = materialise(edges.filter(a != b).select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        then, now = now, materialise(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if before == state:
            remove(then)
            break
        remove(then)
    roots = now.select(F.col("small").alias("node")).distinct()
    return now.select(F.col("big").alias("node"), F.col("small").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
