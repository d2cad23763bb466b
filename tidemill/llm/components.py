"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join over links; the links are written to the
shared folder after each round, which ends their lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import release, removed, work_dir, written


def _large_star(links: DataFrame, path: str) -> DataFrame:
    """Every larger neighbour of a node links to the node's least neighbour (itself included)."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    least = written(least, path)  # a plain side: a hot node's neighbours can be dealt to several tasks
    return both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(links: DataFrame, path: str) -> DataFrame:
    """Every smaller neighbour of a node, and the node, link to its least neighbour. links have a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("n"), "m")
    least = written(least, path)
    down = links.join(least, F.col("b") == F.col("n")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return down.where("a <> b").union(least.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (its component's least node) for every node that a link a - b names; other nodes are their own roots.

    Loops and repeated links are harmless; null ends are dropped; no links give no rows.
    """
    spark = links.sparkSession
    base = work_dir(spark, "components")
    a, b = F.col("a"), F.col("b")
    now = written(links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), f"{base}/0")
    before, k = None, 0
    while True:
        # the same links again, by number and sum of their ends' hashes, are the fixed point
        sign = now.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)")).first()
        if sign == before or not sign[0]:
            break
        before, k = sign, k + 1
        star = written(_large_star(now, f"{base}/{k}-near"), f"{base}/{k}-star")
        later = written(_small_star(star, f"{base}/{k}-least"), f"{base}/{k}")
        for old in (f"{k - 1}", f"{k}-near", f"{k}-star", f"{k}-least"):
            removed(spark, f"{base}/{old}")
        now = later
        release(spark)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())
