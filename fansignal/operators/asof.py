"""Point-in-time view of feature snapshots (the offline store's reading).

For every request (key, time) the newest snapshot of that key that is not younger than the
request. Both sides are laid on one time line and the last snapshot is carried forward, so
each side is read once and no pair of a request and an older snapshot is ever made.

A key may hold a third of all rows: its time line is cut into slices of ``width``, and
windows run inside a (key, slice). What a slice inherits is found on a table of one row per
key and slice: the newest snapshot of each slice, carried over the slices before.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000       # microseconds


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (read as the session's)."""
    return F.unix_micros(t.cast("timestamp"))


def as_of(requests: DataFrame, snapshots: DataFrame, key: str, at: str, event_time: str, width: int = 7 * DAY,
          max_age: int | None = None) -> DataFrame:
    """``requests`` with the snapshot columns (other than the key) of the newest snapshot with
    ``event_time`` <= ``at``; all NULL where there is none, or where it is more than
    ``max_age`` microseconds old. Of snapshots at one time the greatest row counts. Requests with a
    NULL key or time are kept and find nothing; snapshots with one are ignored."""
    clash = (set(requests.columns) & set(snapshots.columns)) - {key}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    taken = [c for c in snapshots.columns if c != key]
    line = lambda df, time, name: df.select(F.col(key).alias("_k"), micros(F.col(time)).alias("_t"), F.struct(*df.columns).alias(name))
    r = line(requests, at, "_r")
    s = line(snapshots.select(key, *taken), event_time, "_s").filter(F.col("_k").isNotNull() & F.col("_t").isNotNull())
    cut = F.floor(F.col("_t") / F.lit(width)).alias("_slice")
    r, s = r.select("*", cut), s.select("*", cut)

    # one row per key and slice
    newest = s.groupBy("_k", "_slice").agg(F.max(F.struct("_t", "_s")).alias("_m"))
    slices = newest.unionByName(r.select("_k", "_slice").distinct(), allowMissingColumns=True).groupBy("_k", "_slice").agg(F.max("_m").alias("_m"))
    before = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    inherited = slices.select("_k", "_slice", F.last("_m", ignorenulls=True).over(before).alias("_m")).filter("_m is not null")

    both = (s.unionByName(inherited.select("_k", "_slice", F.col("_m._t").alias("_t"), F.col("_m._s").alias("_s")))
            .unionByName(r, allowMissingColumns=True))
    w = Window.partitionBy("_k", "_slice").orderBy("_t", F.col("_r").isNotNull(), "_s").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_r").isNull(), F.struct("_t", "_s")), ignorenulls=True).over(w)
    d = both.withColumn("_f", found).filter(F.col("_r").isNotNull())
    fresh = F.lit(True) if max_age is None else F.col("_t") - F.col("_f._t") <= max_age
    return d.select("_r.*", *[F.when(fresh, F.col("_f._s")[c]).alias(c) for c in taken])


def daily_history(team_rows: DataFrame) -> DataFrame:
    """Snapshots for ``as_of``: per team and day with a match, its matches, points and goals so far,
    valid from the end of the day. ``team_rows``: team, utc_date, points, gf, ga."""
    day = F.to_date("utc_date").alias("day")
    per = team_rows.groupBy("team", day).agg(F.count(F.lit(1)).alias("m"), F.sum("points").alias("p"), F.sum("gf").alias("f"), F.sum("ga").alias("a"))
    so_far = Window.partitionBy("team").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)     # rows of a team: its days
    total = lambda c, name: F.sum(c).over(so_far).cast("long").alias(name)
    return per.select("team", F.date_add("day", 1).cast("timestamp_ntz").alias("valid_from"), total("m", "matches_before"),
                      total("p", "points_before"), total("f", "goals_before"), total("a", "conceded_before"))
