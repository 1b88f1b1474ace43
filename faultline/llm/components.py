"""Connected components of a link table by alternating stars; links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import stage


#: Parts into which the links of one node are split where they meet its smallest neighbour.
SALT = 16


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node in `links` (a, b).

    Each step hangs the neighbours of a node on the smallest of them, first the larger ones, then the smaller ones, until
    all hang on the smallest of their component. The number of steps grows with the logarithm of the longest chain.
    """
    edges = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low"))
        large = _meet(both.where("b > a"), "a", low).select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("low")).withColumnRenamed("b", "n")
        small = _meet(large, "b", low).select(F.explode(F.array(
            F.struct(F.col("low").alias("a"), F.col("a").alias("b")), F.struct(F.col("low").alias("a"), F.col("b").alias("b")),
        )).alias("p")).select("p.*")
        edges = stage(small.where("a <> b").distinct(), "links")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return roots.union(edges.select("a", "a").distinct())


def _meet(edges: DataFrame, end: str, low: DataFrame) -> DataFrame:
    """Links with the smallest neighbour of one end; the links of a node are spread over SALT parts."""
    salted = edges.withColumn("salt", F.pmod(F.hash("a", "b"), F.lit(SALT)))
    lows = low.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(lows, (F.col(end) == F.col("n")) & (F.col("salt") == F.col("part")))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free sum of the links; equal when a step changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
