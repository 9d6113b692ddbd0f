"""Connected components of a graph that is given by its edges, without a driver-side structure.

Every round each node hooks onto its least neighbour, the trees that this makes are flattened by pointer jumping, and
the edges are rewritten between roots. Edges shrink at least by half a round. Joins are between written tables only,
so a hub's rows can be split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of the edges (a, b); ids are longs."""
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    whole = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")))
        while True:
            up = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = cut(hooked.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            hooked = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if whole is None:
            whole = hooked
        else:
            up = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
            whole = cut(whole.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        a, b = hooked.select(F.col("node").alias("a"), F.col("root").alias("x")), hooked.select(F.col("node").alias("b"), F.col("root").alias("y"))
        left = edges.join(a, "a").join(b, "b").where("x != y")
        edges = cut(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if whole is None else whole
