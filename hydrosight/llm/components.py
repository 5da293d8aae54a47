"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrosight.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (id, label) for each id in a link; the label is the
    smallest id that links reach.

    Each round every label points to the neighbour, or itself, of the smallest hash, pointers
    are followed twice, and links between the same two labels become one. The hash changes with
    the round, so of a chain, in whatever order its ids stand, about a third stays each round, and a
    star is gone after one or two. A round shuffles the links that remain. The smallest ids are
    found once, at the end.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .distinct(), "links")
    nodes = cut(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
                .select("id", F.col("id").alias("label")), "link-labels")
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        ids = both.union(both.select("a", F.col("a").alias("b")).distinct())  # itself is a candidate too
        # different 64-bit ids have different hashes: the last step of the hash can be undone
        rank = F.xxhash64(F.lit(turn), "b")
        parent = cut(ids.groupBy("a").agg(F.min_by("b", rank).alias("p")), "link-parents")
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            parent = cut(parent.join(up, "p").select("a", F.col("q").alias("p")), "link-parents")
        nodes = cut(nodes.join(parent.select(F.col("a").alias("label"), "p"), "label", "left")
                    .select("id", F.coalesce("p", "label").alias("label")), "link-labels")
        edges = cut(edges.join(parent, "a").select("b", F.col("p").alias("a"))
                    .join(parent.select(F.col("a").alias("b"), "p"), "b")
                    .where("a <> p").select(F.least("a", "p").alias("a"), F.greatest("a", "p").alias("b"))
                    .distinct(), "links")
        turn += 1
    lowest = nodes.groupBy("label").agg(F.min("id").alias("lowest"))
    return cut(nodes.join(lowest, "label").select("id", F.col("lowest").alias("label")), "link-labels")
