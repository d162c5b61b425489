"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b); root is the smallest node reached.

    Each step is one aggregation by node and one join; its edges are written
    in the shared folder, so no step depends on an executor's memory.  Only
    two numbers a round reach the driver.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "cc-edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours are tied to the smallest one
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the node itself are tied to the smallest one
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small_least = down.groupBy("a").agg(F.min("b").alias("m"))
        tied = down.join(small_least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = written(tied.where("a <> b").distinct(), "cc-edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = now
