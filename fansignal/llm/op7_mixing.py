"""Mixing sources to target weights.

Sizes (words) are summed per source; sources in code-point order, null last, get the
weights in turn. The targets share ``percent`` % of all words by weight, but none may pass
``most`` times its source: what is above is shared anew by weight until none is. With the
sources ordered by most * size / weight this is one running sum: the sources below the
water level stop at their limit and the others get level * weight.

A source's rate is target / size. Each document is taken floor(rate) times, and once more
with probability rate - floor(rate), decided by a hash of seed and doc_id. So no document
exceeds ``most`` times its size, reruns agree, and rows that repeat a doc_id share a draw.

Null text: size 0. Null source: a source of its own, last. Sources of size 0 have target
0. A null doc_id draws like the text "null". An empty table gives no rows. Only DataFrame
functions are used.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 100_000  # source rows sent to every task at most; beyond it a shuffle join


def words_in(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, size); one row per source, which is why
    its windows may run in one task."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_limit = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = (per.withColumn("budget", F.sum("source_size").over(everything) * (percent / 100.0))
           .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                       / F.sum("w").over(rest)))
    fits = F.col("level") * F.col("w") <= F.col("cap")
    # the level sinks from source to source, so the first one that fits has the highest
    first = F.max(F.when(fits, F.col("level"))).over(everything)
    return per.select("source", "source_size", F.least("cap", F.coalesce(first * F.col("w"), F.col("cap"))).alias("target"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from 32 bits of md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(documents: DataFrame, weights=(3, 1, 2), percent: int = 150, most: int = 2, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``documents`` with added columns mix_size, mix_source_size, mix_target and mix_copies
    (how many times the mix takes the document); one row per input row. Columns of these
    names in ``documents`` are replaced."""
    d = documents.withColumn("mix_size", words_in(F.col(text_col)))
    targets = source_targets(d.select(F.col(source_col).alias("source"), F.col("mix_size").alias("size")),
                             weights, percent, most)
    targets = targets.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"),
                             F.col("target").alias("mix_target"))
    if documents.select(source_col).distinct().count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    j = d.join(targets, d[source_col].eqNullSafe(targets.mix_source), "left").drop("mix_source")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    whole = F.floor(rate)
    return j.withColumn("mix_copies", (whole + (draw(F.col(id_col), seed) < rate - whole).cast("int")).cast("int"))


def emitted(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the given columns."""
    copies = F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    return mixed.filter("mix_copies > 0").withColumn("mix_copy", copies).select(*columns)
