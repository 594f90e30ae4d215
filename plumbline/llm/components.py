"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.session import settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: tie the neighbours of every node to the smallest node among itself and its neighbours.

    A large star ties the larger neighbours, a small star the smaller ones and the node itself. Only a minimum
    is aggregated per node, which combines before the shuffle; no neighbourhood is ever collected.
    """
    if large:
        ends = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = ends.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = ends.join(lowest, "a")
    if large:
        moved = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(lowest.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the smallest node that is reachable.

    Every round is written to the shared folder, so a lost executor costs one round. The rounds end when the
    edges no longer change, which takes about the logarithm of the longest path.
    """
    current = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                     .where("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        current = settle(_stars(_stars(current, large=True), large=False))
        sign = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
