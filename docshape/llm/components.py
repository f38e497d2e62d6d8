"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docshape.llm.common import drop_written, written


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every node of an edge ``a``, ``b``.

    Each round moves every node's larger neighbours, then its smaller ones, onto the
    smallest neighbour known; rounds grow with the logarithm of the longest path. A
    node of any degree is handled by a partial minimum and a join; each round is
    written to the shared folder and the one before it deleted. An edge from a node to
    itself, or from or to null, is ignored; without edges there are no rows.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        # Here a > b holds in every edge.
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least).where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(now)
    while before[0]:
        following = written(small(large(now)), "edges")
        drop_written(now)
        now, after = following, state(following)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
