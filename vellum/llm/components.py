"""Connected components of a large link table by alternating star contraction.

The links never leave the executors: each round is a few aggregates and one join on the link table, and its outcome is
written to the shared checkpoint folder and read back. Minima are combined map-side, and the join on a node with very many links is
split by the engine's skew handling, so a star of any size is safe. The number of rounds grows with the logarithm of
the longest chain; the loop ends when a round changes nothing, not after a fixed number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import Rounds


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.max(F.xxhash64("b", "a"))).first()
    return tuple(r)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b; undirected): root is the least node reachable.

    Self links and repeated links are harmless; an empty table gives an empty result.
    """
    rounds = Rounds(links.sparkSession)
    cur = rounds.cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(cur)
    while state[0]:
        # large star: every larger neighbour of a node is linked to the least node of its neighbourhood
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour of a node, and the node itself, is linked to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        cur = rounds.cut(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        new = _state(cur)
        if new == state:
            break
        state = new
    roots = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
