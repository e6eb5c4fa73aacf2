"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of ``edges`` (a, b): the least node that it reaches.

    Every pass hooks each node to the least label around it and then follows
    labels once more, so paths at least halve; a star takes two passes. Only
    one row per node and edge is ever shuffled, aggregates combine before the
    shuffle, and each pass is written to the shared folder. Null ends are left out.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = written(both.union(both.select("v", "u")).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("low"))
        hooked = labels.join(near, "u").select("u", F.col("label").alias("was"), F.least("label", "low").alias("low"))
        jump = labels.select(F.col("u").alias("low"), F.col("label").alias("far"))
        after = hooked.join(jump, "low").select("u", "was", F.least("low", "far").alias("label"))
        done = written(after, "labels")
        changed = done.where("was <> label").limit(1).count()
        remove(labels)
        labels = done.select("u", "label")
        if not changed:
            remove(both)
            return labels.withColumnRenamed("u", "node")
