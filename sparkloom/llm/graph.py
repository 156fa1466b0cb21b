"""Connected components over a link table, by joins; nothing is gathered on the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import hot_keys, split_join, stash


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an undirected link table: comp is the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label of that label
    (pointer jumping), so the rounds grow with the logarithm of a chain's length. Rounds are
    written to the shared folder. Nodes with very many links and labels of very many nodes are
    dealt to several tasks. Nulls and self-links are ignored; no links give no rows.
    """
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    edges = stash(edges.union(edges.select("y", "x")).distinct(), "edges")
    labels = stash(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("comp")), "labels")
    hot = hot_keys(edges, "y")
    while True:
        near = split_join(edges, labels.withColumnRenamed("node", "y"), "y", hot=hot).groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("m"))
        lower = stash(labels.join(near, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp")), "lower")
        known = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        after = stash(split_join(lower, known, "comp", "left").select("node", "old", F.least("comp", "next").alias("comp")), "labels")
        labels = after.select("node", "comp")
        if after.where("comp <> old").isEmpty():
            return labels
