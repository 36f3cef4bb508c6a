"""Connected components by alternating large-star and small-star steps.

Every step is a group-by-minimum with map-side combine and a join against one row per node. The
minima are written first, so that both sides of the join are plain shuffles and Spark can split a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """``node, label`` for every node of ``edges(u, v)``; the label is the component's smallest node.

    Null ends and loops are ignored; an empty edge table gives an empty result.
    """
    node = edges.schema["u"].dataType
    e = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n = e.count()
    if not n:
        return e.select(F.col("u").cast(node).alias("node"), F.col("v").cast(node).alias("label"))
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large", 2 * n)
        large = scratch.write(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star", 2 * n)
        low2 = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), "small", 2 * n)
        moved = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e2 = scratch.write(moved.union(low2.select("u", F.col("m").alias("v"))).distinct(), "small-star", 2 * n)
        scratch.delete(e, low, large, low2)
        e = e2
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    star = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out = scratch.write(star.union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "components", 2 * n)
    scratch.delete(e)
    return out
