"""Connected components of a link table by hooking and contraction.

In a round every node hooks onto its least neighbour, if that is smaller; pointers are followed to their ends by doubling; and
the links are rewritten to the ends, those inside one end being dropped. Of the ends that still have links at least half go in
a round, so rounds grow with the logarithm of the nodes. Nothing leaves the executors but whether a table is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import Rounds, cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (columns a, b; undirected): root is the least node reachable."""
    spark = links.sparkSession
    ends, labels = Rounds(spark), Rounds(spark)
    pairs = links.where("a <> b").select("a", "b")
    left = ends.cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label: DataFrame | None = None
    while not left.isEmpty():
        up = left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("up"))
        hops, moved = Rounds(spark), True
        while moved:
            ahead = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            up = hops.cut(up.join(ahead, "up").select("node", F.col("next").alias("up"), (F.col("next") < F.col("up")).alias("moved")))
            moved = not up.where("moved").isEmpty()
            up = up.drop("moved")
        if label is None:
            label = labels.cut(up.withColumnRenamed("up", "root"))
        else:
            label = labels.cut(label.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        one = left.join(up.select(F.col("node").alias("a"), F.col("up").alias("ra")), "a")
        both = one.join(up.select(F.col("node").alias("b"), F.col("up").alias("rb")), "b")
        left = ends.cut(both.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    return cut_lineage(pairs.select(F.col("a").alias("node"), F.col("a").alias("root")) if label is None else label)
