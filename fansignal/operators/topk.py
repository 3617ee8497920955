"""Exact top-k per group that survives a hot group key, and ranks of a whole table.

Stage 1 ranks inside (group, salt) sub-groups, keeping at most k rows each; stage 2 ranks
the at most k * salt survivors of each group. Both windows see bounded partitions even
when one group holds a third of all rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fansignal.sources.tables import staged


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                    salt_buckets: int = 32, salt_cols: list[str] | None = None,
                    rank_col: str = "rank") -> DataFrame:
    salt_src = [F.col(c) for c in (salt_cols or [c for c in df.columns if c not in keys])]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    s1 = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return s1.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)


def global_rank(df: DataFrame, order: list[Column], rank_col: str = "rank") -> DataFrame:
    """The place of every row in the whole table, from 1, without bringing it into one task: rows
    are range-partitioned by ``order`` and numbered inside their partition; the
    partitions' offsets are a window over one row per partition. Stored once, so that both
    uses see the same partitions."""
    dealt = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_part").alias("_p"), (before - F.col("_first") + 1).alias("_shift"))
    j = dealt.join(offsets, part == F.col("_p"))
    return j.withColumn(rank_col, F.col("_at") + F.col("_shift")).drop("_at", "_p", "_shift")
