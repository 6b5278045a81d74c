"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long, any order) -> node, root: every node of an edge with the smallest node it can reach.

    Every round is written to the shared folder, so lineage stays short and a lost executor costs one round at most.
    Minima are aggregated before they are joined, so a hub costs rows in proportion to its edges only.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        n, mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == seen or not n:
            break
        seen = n, mark
        both = now.union(now.select("v", "u")).toDF("x", "y")
        lows = stored(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "lows")
        wide = both.where("y > x").join(lows, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        wide = stored(wide, "wide")
        lows = stored(wide.groupBy("u").agg(F.min("v").alias("m")), "lows")
        near = wide.join(lows, "u")
        now = stored(near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lows.select("u", F.col("m"))).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
