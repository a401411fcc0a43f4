"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Each node's neighbours above it (large) or not above it (small) are hung under its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select("b", "a"))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node that links reach.

    Self links and repeated links are allowed; a null end drops the link. Only two numbers a
    round come to the driver. Rounds grow with the logarithm of the longest path. The result is a written table; release() it.
    """
    edges = materialize(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        after = materialize(_star(_star(edges, True), False), "links")
        state = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        release(edges)
        edges = after
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = materialize(pairs.union(edges.select("b", "b").distinct()), "roots")
    release(edges)
    return roots
