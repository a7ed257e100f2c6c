"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from heronlake.llm.common import forget, written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), longs; the component is its smallest node.

    Each round is two joins on a node with its smallest neighbour, and rows
    never outnumber the edges.  Self-loops and repeated edges change nothing;
    an edge with a null is left out.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        # Each larger neighbour of u points to the smallest around u.
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = written(large, "cc")
        least = _least(large)
        small = large.join(least, F.col("a") == F.col("u"))
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        seen = Observation()
        before, now = now, written(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "cc")
        forget(before, large)
        got = seen.get
        if got == mark:
            break
        mark = got
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
