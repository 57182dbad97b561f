"""Connected components of a graph given by its edges, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import staged


def components(edges: DataFrame, work: str | None = None) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b``, longs); the root is the least node of its component.

    Large-star and small-star rounds: every node hands its larger neighbours, then all of its smaller ones and itself,
    to the least node it knows, until nothing changes. The number of rounds grows with the logarithm of a component's size;
    each is an aggregation with partial sums and a join, and is written, so a lost executor costs one round.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    pairs = staged(pairs, "edges", work)
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        pairs = staged(small, "edges", work)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
