"""Connected components by alternating large and small stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _stars(both: DataFrame, larger: bool) -> DataFrame:
    """Hang each node's neighbours (all larger ones, or all smaller ones and itself) on its least neighbour.

    The least is a pre-aggregated minimum and comes back by a join that can be split where a node is hot.
    """
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    pairs = both.join(least, "u")
    if larger:
        found = pairs.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = pairs.where("v < u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
    return found.where("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge table (a, b), component being the least node reachable.

    Rows with a null or equal ends are left out. Few rounds are needed: their number grows with the logarithm of the
    longest chain.
    """
    flat = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    now = written(flat, "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = _stars(both, larger=True)
        new = written(_stars(wide, larger=False), "stars")
        discard(now)
        now = new
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
