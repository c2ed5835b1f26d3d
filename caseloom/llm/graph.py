"""Connected components of an edge table, by joins and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the component's smallest node.

    Each round takes the smallest root among a node's neighbours and then the
    root of its root, so that distances halve. Each round is written to the
    checkpoint folder; only the number of changed nodes reaches the driver.
    Minima combine before the shuffle, so a node with many edges is no hot key.
    An empty edge table gives an empty result.
    """
    both = stored(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    )
    roots = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hooked = roots.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hooked = stored(hooked)
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = hooked.join(above, "root").select("node", F.least("root", "top").alias("root"), "old")
        jumped = stored(jumped)
        roots = jumped.select("node", "root")
        if jumped.where("root <> old").isEmpty():
            return roots
