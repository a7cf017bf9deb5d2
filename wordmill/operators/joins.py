"""Lookup joins whose hot keys are not shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in ``HOT_SHARE`` is hot, so fewer than that many are.
HOT_SHARE = 1000


def hot_split_join(df: DataFrame, table: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Left join of ``df`` with ``table`` (unique in ``key``), for tables of any size.

    One aggregate counts the keys (combined map-side). Rows of hot keys, and rows without a key,
    meet the few table rows of those keys by a broadcast and stay where they are; all others are
    joined by a shuffle in which no key has more than its share. Every row of ``df`` comes out
    once, with nulls where the table has no row.
    """
    total = df.count()
    hot = (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") * share > total).select(F.col(key).alias("_hot")))
    marked = df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    still = F.col("_hot").isNotNull() | F.col(key).isNull()
    few = F.broadcast(table.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left_semi"))
    return (marked.where(still).drop("_hot").join(few, key, "left")
            .unionByName(marked.where(~still).drop("_hot").join(table, key, "left")))
