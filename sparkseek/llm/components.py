"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import durable, no_automatic_broadcasts


def _jumped(parent: DataFrame) -> DataFrame:
    """Every node's root, by pointer jumping, two jumps a round: the number of rounds is the logarithm of the longest path."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        once = parent.join(up, "root").select("node", F.col("_up").alias("root"))
        new = durable(once.join(up, "root").select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")))
        parent = new.select("node", "root")
        if new.where("_moved").isEmpty():
            return parent


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of type long. Returns (node, root) for every node that has a link; root is the component's least node.

    Each round hooks every node to its least neighbour, follows the hooks to their roots, and contracts the
    links to links between roots, until none is left. All tables are cut off by checkpoints. Links of a
    node are first added up in each task; joins on a node with very many links are split by adaptive execution.
    """
    with no_automatic_broadcasts(links.sparkSession):
        return _components(links)


def _components(links: DataFrame) -> DataFrame:
    links = durable(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("_other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("_other")))
        parent = durable(both.groupBy("node").agg(F.min("_other").alias("_least")).select("node", F.least("node", "_least").alias("root")))
        parent = _jumped(parent)
        ends = [parent.select(F.col("node").alias(x), F.col("root").alias(f"_{x}")) for x in "ab"]
        found = parent if found is None else durable(found.join(parent.select(F.col("node").alias("root"), F.col("root").alias("_up")), "root", "left").select("node", F.coalesce("_up", "root").alias("root")))
        links = links.join(ends[0], "a").join(ends[1], "b").where("_a <> _b")
        links = durable(links.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
