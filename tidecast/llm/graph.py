"""Connected components as DataFrame operations: alternating large-star and small-star, no link ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise, release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links, in any order and repeated -> (node, component): the least node reachable.

    Each round is two aggregations keyed by node; a star of any size is combined before the shuffle by min().
    Nodes without a link do not appear. Raises if max_rounds do not converge.
    """
    spark = edges.sparkSession
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    kept: list[str] = []
    now = materialise(now, kept)
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new_path: list[str] = []
        new = materialise(small, new_path)
        state = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        release(spark, kept.pop())
        kept += new_path
        now = new
        if state == before:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
    raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
