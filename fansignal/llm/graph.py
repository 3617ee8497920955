"""Connected components of a link table, as rounds of joins (large-star / small-star)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fansignal.sources.tables import staged


def _with_min(e: DataFrame, include_self: bool) -> DataFrame:
    m = e.groupBy("u").agg(F.min("v").alias("m"))
    if include_self:
        m = m.select("u", F.least("m", "u").alias("m"))
    return e.join(m, "u")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_with_min(both, True).filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    j = _with_min(e, False)
    low = j.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.unionByName(j.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without a link
    to another node are absent. Each round is written to the shared folder, so a lost
    executor costs one round at most; a node with very many links is a join key whose
    partition adaptive execution splits. Null ends are ignored."""
    e = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    e = staged(e, "links")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    seen = None
    for _ in range(rounds):
        e = staged(_small_star(_large_star(e)), "stars")
        now = e.agg(F.count(F.lit(1)), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
