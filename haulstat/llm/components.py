"""Connected components of links that are spread over many tasks."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(links: DataFrame, kind: str = "long") -> DataFrame:
    """(node, root) of undirected ``links`` (a, b); the root is a component's smallest node.

    Alternating stars: every node hands its larger neighbours, then its
    smaller ones, to its smallest neighbour, until nothing changes. The number
    of links never grows, and the rounds grow with the logarithm of the longest
    chain. Every round is written to the shared folder. Only a count and a
    checksum come to the driver. Nulls, loops and repeated links are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") > F.col("v")).distinct()
    edges = cut_lineage(edges)
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # The smallest neighbour of u also takes u itself when it is smaller.
        own = low.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))
        large = cut_lineage(large.unionByName(own).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


class Forest:
    """Union-find inside one task: says which links join two trees, so that only those leave the task."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def joins(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
