"""Connected components of a graph of any size, by joins and sums alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import Scratch


def _mark(star: DataFrame):
    """Equal for equal edges: their number and the sum of their hashes."""
    return star.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``edges``; a component is named by its smallest node.

    Every round hangs each node's larger neighbours, then each node's smaller neighbours, on the
    smallest one; a chain halves each time, and the rounds end when only stars are left. The
    smallest neighbour is a map-side minimum and is joined back, so no node's neighbours ever meet
    in one task. Loops, nulls, repeated and reversed edges do no harm; no edges give no rows.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    star = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    star = scratch.save(star.where("u != v").distinct(), "edges")
    mark = _mark(star)
    while True:
        both = star.select("u", "v").union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that the join stands alone and Spark can split a node with very many edges.
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.where("u != v").distinct(), "large")
        lower = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "lower")  # here every v is smaller than its u
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = scratch.save(small.union(lower.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        for done in (star, least, large, lower):
            scratch.drop(done)
        star = following
        now = _mark(star)
        if now == mark:
            break
        mark = now
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
