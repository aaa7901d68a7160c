"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import checkpoint


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """``node, component`` (the least node of the component) of each node that has an edge.

    Large-star and small-star rounds over the whole edge table: each node's neighbours are linked to the
    least of them, without collecting any neighbourhood (the least neighbour is an aggregate that is
    combined before the shuffle), so a node with a third of all edges is no bottleneck. The number of
    rounds grows with the logarithm of the component size; every round is cut by a checkpoint in the shared
    folder. Null ends, loops and repeated edges are ignored; an empty table gives an empty result.
    """
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    # Stars keep (node, lower): every edge points from the larger end to the smaller one.
    stars = checkpoint(links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("low")).distinct())
    for _ in range(max_rounds):
        # Large star: every neighbour larger than the node goes to the least of the node and its neighbours.
        both = stars.select("node", "low").union(stars.select(F.col("low").alias("node"), F.col("node").alias("low")))
        least = both.groupBy("node").agg(F.least(F.min("low"), F.first("node")).alias("m"))
        large = both.join(least, "node").where("low > node").select(F.col("low").alias("node"), F.col("m").alias("low"))
        large = large.distinct()
        # Small star: the node and its lower neighbours go to the least of them.
        lowest = large.groupBy("node").agg(F.min("low").alias("m"))
        small = large.join(lowest, "node").select(F.explode(F.array(F.struct("node", F.col("m").alias("low")), F.struct(F.col("low").alias("node"), F.col("m").alias("low")))).alias("x")).select("x.*")
        after = checkpoint(small.where("node != low").distinct())
        # Done when no edge changed: then each node has one edge, to the least node of its component.
        same = after.count() == stars.count() and after.join(stars, ["node", "low"], "left_anti").isEmpty()
        stars = after
        if same:
            return stars.select("node", F.col("low").alias("component")).union(stars.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
