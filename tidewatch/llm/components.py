"""Connected components of a graph of links, as joins that halve the distance to the least node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """node, label: the least node that links (columns a, b) connect it with.

    ``before``: labels of earlier links, which are kept connected. A round
    takes the least label among neighbours, then the label's own label; the
    rounds are about the logarithm of the longest path. Each round is written
    to the shared folder. Nodes without a link have no row.
    """
    e = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    if before is not None:
        e = e.unionByName(before.select(F.col("node").alias("a"), F.col("label").alias("b")))
    e = e.where("a <> b")
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        told = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        near = labels.join(told, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        far = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(near.join(far, "label").select("node", F.least("label", "next").alias("label"), "old"))
        if not new.where("label <> old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
