"""Connected components by alternating large-star and small-star.

Every round is two grouped minima and two joins on the node, so no neighbourhood is ever gathered:
minima are combined before the shuffle, and joins with a node of very many edges are split by the
adaptive skew join. Rounds are written to the shared folder, so a lost executor repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.common import forget, shared_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that each end of an edge reaches.

    `edges` has two long columns a and b; loops and repeated edges are allowed, nulls are left out.
    Without edges the result is empty.
    """
    now = shared_table(edges.select("a", "b").where("a <> b").distinct(), name)
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = mark
        after = shared_table(_small_star(_large_star(now)), name)
        forget(now)
        now = after
