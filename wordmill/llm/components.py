"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined map-side) and a join; tables between rounds are written
to the shared folder, so lineage stays short and lost executors only cost a task. Nothing about
nodes or links reaches the driver but two sums per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import drop, written


def join_by_weight(left: DataFrame, right: DataFrame, key: str, weight: str, total: int,
                   k: int = 1000) -> DataFrame:
    """Inner join on ``key``, unique in ``right``; ``weight`` is how many rows of ``left`` have
    it, of ``total``. Keys with over total / k rows, fewer than k of them, are broadcast, so no
    hot key is shuffled."""
    hot = F.broadcast(right.where(F.col(weight) * k > total))
    cold = right.where(F.col(weight) * k <= total)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(cold, key))


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (long columns ``a``, ``b``): root is the
    smallest node of its component. Self-links and repeated links do no harm."""
    spark = edges.sparkSession
    state, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"),
                                                       F.least("a", "b").alias("v")).distinct(),
                          "links")
    seen = None
    for _ in range(rounds):
        sums = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(sums) == seen or not sums[0]:
            break
        seen, n = tuple(sums), sums[0]
        # large star: each node hands its larger neighbours to its smallest neighbour or itself
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _smallest(both).withColumn("m", F.least("m", "u"))
        large, p1 = written(join_by_weight(both, low, "u", "w", 2 * n).where("v > u")
                            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: each node hands itself and its smaller neighbours to the smallest of them
        n2 = large.count()
        near = join_by_weight(large, _smallest(large), "u", "w", n2)
        new = (near.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state, p2 = written(new, "small")
        drop(spark, path)
        drop(spark, p1)
        path = p2
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return (state.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
