"""Sentiment analytics over scored posts.

Posts: timestamp (ts / ts_ntz), sentiment_label, sentiment_score, entities array<struct<name,..>>,
source, text. Buckets are tumbling ``window`` aggregates, so partial aggregation happens
map-side and only one row per (partition, bucket) is shuffled. Global statistics over
buckets are a one-row aggregate broadcast to the bucket rows (never an unkeyed Window).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fansignal.functions.common import epoch_seconds
from fansignal.functions.scoring import tokens
from fansignal.sources.tables import staged

LABELS = ["positive", "negative", "neutral"]


def _interval(interval: str) -> str:
    """'15m' / '1h' / '15 minutes' -> Spark interval text."""
    s = interval.strip()
    units = {"m": "minutes", "h": "hours", "s": "seconds", "d": "days"}
    if s[-1] in units and s[:-1].isdigit():
        return f"{s[:-1]} {units[s[-1]]}"
    return s


def time_range(posts: DataFrame, as_of: Column, hours_back: float | None, ts: str = "timestamp") -> DataFrame:
    """Keep posts with as_of - hours_back <= ts <= as_of. ``None`` keeps everything."""
    if hours_back is None:
        return posts
    lo = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(round(hours_back * 60))))
    return posts.filter((F.col(ts) >= lo) & (F.col(ts) <= as_of))


def bucket_stats(posts: DataFrame, interval: str = "15m", ts: str = "timestamp") -> DataFrame:
    """G02 + G04 + G06: per tumbling bucket: avg score, doc count, label counts, non-null label count."""
    lab = F.col("sentiment_label")
    return (posts.groupBy(F.window(ts, _interval(interval)).start.alias("bucket"))
            .agg(F.avg("sentiment_score").alias("avg_score"),
                 F.count(F.lit(1)).alias("doc_count"),
                 *[F.count_if(lab == x).alias(x) for x in LABELS],
                 F.count(lab).alias("post_count")))


def fill_gaps(buckets: DataFrame, interval: str = "15m", bucket: str = "bucket") -> DataFrame:
    """Add empty buckets between the first and last bucket (NULL avg, zero counts).
    The bucket span is bounded by the queried time range, not by the data volume."""
    iv = F.expr(f"INTERVAL {_interval(interval)}")
    span = buckets.agg(F.min(bucket).alias("lo"), F.max(bucket).alias("hi"))
    grid = span.select(F.explode(F.sequence("lo", "hi", iv)).alias(bucket))
    counts = [c for c in buckets.columns if c not in (bucket, "avg_score")]
    out = grid.join(buckets, bucket, "left")
    return out.select(bucket, "avg_score", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts])


def top_entities(posts: DataFrame, interval: str = "15m", k: int = 5, ts: str = "timestamp") -> DataFrame:
    """Top-k entity names per bucket by mention count (ties: name ascending).
    Counting is a partial aggregate on (bucket, name); only the counts are ranked."""
    ex = posts.select(F.window(ts, _interval(interval)).start.alias("bucket"),
                      F.explode("entities").alias("e"))
    cnt = ex.groupBy("bucket", F.col("e.name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("bucket").orderBy(F.col("n").desc(), F.col("name"))
    return cnt.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def timeline(posts: DataFrame, as_of: Column, hours_back: float | None = 24, interval: str = "15m",
             ts: str = "timestamp") -> DataFrame:
    """One row per non-empty bucket with label counts and top entities joined by ', '."""
    p = time_range(posts, as_of, hours_back, ts)
    b = bucket_stats(p, interval, ts).filter(F.col("avg_score").isNotNull())
    te = (top_entities(p, interval, 5, ts).groupBy("bucket")
          .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))),
                                        lambda s: s["name"]), ", ").alias("top_entities")))
    return (b.join(te, "bucket", "left")
            .select(F.col("bucket").alias("timestamp"), F.col("avg_score").alias("avg_sentiment"),
                    "doc_count", "post_count", *LABELS,
                    F.coalesce("top_entities", F.lit("")).alias("top_entities")))


def detect_spikes(posts: DataFrame, as_of: Column, interval: str = "15m", hours_back: float | None = 24,
                  std_threshold: float = 2.0, min_buckets: int = 3, ts: str = "timestamp") -> DataFrame:
    """Buckets whose average deviates from the mean of bucket averages by more than
    ``std_threshold`` population standard deviations (needs >= ``min_buckets`` buckets)."""
    p = time_range(posts, as_of, hours_back, ts)
    b = bucket_stats(p, interval, ts).filter(F.col("avg_score").isNotNull())
    stats = b.agg(F.avg("avg_score").alias("mu"), F.stddev_pop("avg_score").alias("sigma"),
                  F.count(F.lit(1)).alias("n_buckets"))
    # ``stats`` is exactly one row: broadcasting it is a size-proven choice.
    j = b.crossJoin(F.broadcast(stats))
    dev = F.abs(F.col("avg_score") - F.col("mu"))
    spikes = j.filter((F.col("n_buckets") >= min_buckets) & (dev > F.lit(std_threshold) * F.col("sigma")))
    te = (top_entities(p, interval, 5, ts).join(spikes.select("bucket"), "bucket", "left_semi")
          .groupBy("bucket").agg(F.array_join(F.transform(
              F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]), ", ")
              .alias("top_entities")))
    return (spikes.join(te, "bucket", "left").select(
        F.col("bucket").alias("timestamp"),
        F.when(F.col("avg_score") > F.col("mu"), "positive").otherwise("negative").alias("direction"),
        F.col("avg_score"),
        F.when(F.col("sigma") > 0, dev / F.col("sigma")).otherwise(F.lit(0.0)).alias("deviation_sigmas"),
        F.col("doc_count").alias("post_count"), *LABELS,
        F.coalesce("top_entities", F.lit("")).alias("top_entities")))


def order_spikes(spikes: DataFrame) -> DataFrame:
    """Strongest first; bucket time breaks ties."""
    return spikes.orderBy(F.col("deviation_sigmas").desc(), F.col("timestamp"))


def events_near(spikes: DataFrame, matches: DataFrame, window_minutes: int = 30,
                max_matches: int | None = None, spike_ts: str = "timestamp") -> DataFrame:
    """Goals and cards of matches kicking off within +-window of each spike.

    Range join as an equi join: matches are keyed by an hour bin of kickoff; each spike
    lists the few bins its window touches, so the join never compares all pairs. The
    exact interval test runs after the equi join.
    """
    bin_s = 3600
    w_s = window_minutes * 60
    sp = spikes.select(F.col(spike_ts).alias("spike_ts")).distinct()
    t = epoch_seconds("spike_ts")
    sp = sp.withColumn("bin", F.explode(F.sequence(F.floor((t - w_s) / bin_s), F.floor((t + w_s) / bin_s))))
    m = matches.select("match_id", "home_team", "away_team", "utc_date", "goals", "cards") \
        .withColumn("bin", F.floor(epoch_seconds("utc_date") / bin_s))
    lo = F.col("spike_ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(window_minutes))
    hi = F.col("spike_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(window_minutes))
    j = sp.join(m, "bin").filter((F.col("utc_date") >= lo) & (F.col("utc_date") <= hi)).drop("bin")
    if max_matches is not None:
        w = Window.partitionBy("spike_ts").orderBy("utc_date", "match_id")
        j = j.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_matches).drop("_r")
    label = F.concat_ws(" vs ", "home_team", "away_team")

    def detail(who):
        return F.format_string("%s (%s) %s'", F.coalesce(who, F.lit("None")),
                               F.coalesce(F.col("x.team"), F.lit("None")),
                               F.coalesce(F.col("x.minute").cast("string"), F.lit("None")))
    g = j.select("spike_ts", "match_id", label.alias("match"), F.posexplode("goals").alias("pos", "x")) \
        .select("spike_ts", "match_id", "match", "pos", F.lit("GOAL").alias("type"), detail(F.col("x.scorer")).alias("detail"))
    c = j.select("spike_ts", "match_id", label.alias("match"), F.posexplode("cards").alias("pos", "x")) \
        .select("spike_ts", "match_id", "match", "pos", F.coalesce(F.col("x.card"), F.lit("CARD")).alias("type"),
                detail(F.col("x.player")).alias("detail"))
    return g.unionByName(c)


def event_marker(event_type: Column) -> Column:
    """GOAL -> goal, type containing 'YELLOW' (case-sensitive, as written) -> yellow, else red."""
    return (F.when(event_type == "GOAL", "goal").when(event_type.contains("YELLOW"), "yellow")
            .otherwise("red"))


def label_distribution(posts: DataFrame, k: int = 3) -> DataFrame:
    """Top-k labels by post count."""
    return (posts.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("posts"))
            .orderBy(F.col("posts").desc(), "sentiment_label").limit(k))


def post_volume(posts: DataFrame, interval: str = "15m", ts: str = "timestamp") -> DataFrame:
    """Post count per bucket."""
    return posts.groupBy(F.window(ts, _interval(interval)).start.alias("bucket")).agg(
        F.count(F.lit(1)).alias("posts"))


def sentiment_by_source(posts: DataFrame, interval: str = "1h", k: int = 5, ts: str = "timestamp") -> DataFrame:
    """Avg score per bucket for the top-k sources by volume. The top-k list has at most
    k rows, so the semi join broadcasts a bounded side."""
    top = (posts.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.col("n").desc(), "source").limit(k).select("source"))
    p = posts.join(F.broadcast(top), "source", "left_semi")
    return p.groupBy(F.window(ts, _interval(interval)).start.alias("bucket"), "source").agg(
        F.avg("sentiment_score").alias("avg_sentiment"), F.count(F.lit(1)).alias("posts"))


def sentiment_over_time(posts: DataFrame, interval: str = "15m", ts: str = "timestamp") -> DataFrame:
    """Avg score per bucket (the same aggregate as G02)."""
    return posts.groupBy(F.window(ts, _interval(interval)).start.alias("bucket")).agg(
        F.avg("sentiment_score").alias("avg_sentiment"))


# ---- team mentions (H01-H03) -------------------------------------------------

TEAM_TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"


def _tok(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), TEAM_TOKEN_SPLIT), lambda t: t != "")


def mentions_team(text: Column, team_name: str, strict: bool = False) -> Column:
    """Analysed-text match of one team name (any token; ``strict`` = all tokens)."""
    want = [t for t in __import__("re").split(r"[^\w]+", team_name.lower()) if t]
    toks = _tok(text)
    conds = [F.array_contains(toks, t) for t in want]
    if not conds:
        return F.lit(False)
    out = conds[0]
    for c in conds[1:]:
        out = (out & c) if strict else (out | c)
    return out


def team_token_table(teams: DataFrame, team_col: str = "team") -> DataFrame:
    """(team, token, n_tokens) for a team dimension."""
    t = teams.select(F.col(team_col).alias("team")).distinct().withColumn("_toks", F.array_distinct(_tok(F.col("team"))))
    return t.select("team", F.explode("_toks").alias("token"), F.size("_toks").alias("n_tokens"))


def post_team_pairs(posts: DataFrame, teams: DataFrame, post_id: str = "post_id", text: str = "text",
                    team_col: str = "team", strict: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(post_id, team) for every post that mentions a team, all teams in one join; with
    the post's columns ``carry``, which travel along instead of being joined back.

    Post tokens are de-duplicated per post and joined to the team-token table. That table
    is a dimension (one row per team token). It is stored first, so that the planner knows its
    bytes and not those of the matches it comes from: the tokens of all posts are then shuffled
    only if it is too large to be broadcast.
    """
    tt = staged(team_token_table(teams, team_col), "team-tokens")
    carry = carry or []
    pt = posts.select(F.col(post_id).alias("post_id"), *carry, F.explode(F.array_distinct(_tok(F.col(text)))).alias("token"))
    hit = pt.join(tt, "token")
    agg = hit.groupBy("post_id", "team", *carry).agg(F.count(F.lit(1)).alias("_m"), F.first("n_tokens").alias("_n"))
    if strict:
        agg = agg.filter(F.col("_m") == F.col("_n"))
    return agg.select("post_id", "team", *carry)


def team_sentiment(posts: DataFrame, teams: DataFrame, as_of: Column, hours_back: float | None = 48,
                   post_id: str = "post_id", text: str = "text", ts: str = "timestamp",
                   team_col: str = "team", strict: bool = False) -> DataFrame:
    """Per team over the last ``hours_back`` hours: avg score (NULL or 0 -> 0.5), post
    count (non-null labels), positive / negative ratios. Teams without posts get defaults.
    Hot teams are fine: the aggregate is partial (map-side) before the shuffle on team."""
    p = time_range(posts, as_of, hours_back, ts)
    teams = staged(teams.select(team_col).distinct(), "team-names")     # read for the tokens and for the defaults
    scored = post_team_pairs(p, teams, post_id, text, team_col, strict, carry=["sentiment_label", "sentiment_score"])
    lab = F.col("sentiment_label")
    agg = scored.groupBy("team").agg(
        F.avg("sentiment_score").alias("_avg"), F.count(lab).alias("post_count"),
        F.count_if(lab == "positive").alias("_pos"), F.count_if(lab == "negative").alias("_neg"))
    allt = teams.select(F.col(team_col).alias("team"))
    out = allt.join(agg, "team", "left")
    n = F.greatest(F.coalesce(F.col("post_count"), F.lit(0)), F.lit(1))
    return out.select(
        "team",
        F.coalesce(F.when(F.col("_avg") != 0, F.col("_avg")), F.lit(0.5)).alias("avg_sentiment"),
        F.coalesce(F.col("post_count"), F.lit(0)).alias("post_count"),
        (F.coalesce(F.col("_pos"), F.lit(0)) / n).alias("positive_ratio"),
        (F.coalesce(F.col("_neg"), F.lit(0)) / n).alias("negative_ratio"))
