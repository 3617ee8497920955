"""Football-shaped views derived from the generated test tables (see FIXTURES.md).

The test tables hold no football data; these deterministic derivations give the
operators realistic inputs. The same derivations are written as SQL in
``fansignal.plans.oracle`` so an independent engine sees the same rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fansignal.functions import match as mf
from fansignal.sources.tables import file_bytes, materialized, table
from fansignal.sources import matches as msrc

AS_OF = "2024-01-31 00:00:00"
# Team sentiment is asked for at a time inside the posts of texts_v, with hours before it, so that
# posts fall out on both sides (the first starts at midnight, one a minute).
SENTIMENT_AS_OF = "2024-01-01 12:00:00"
SENTIMENT_HOURS = 8


def as_of_col() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def sentiment_as_of() -> Column:
    return F.lit(SENTIMENT_AS_OF).cast("timestamp_ntz")


def _source_of(user_id: Column) -> Column:
    m = user_id % 3
    return F.when(m == 0, "reddit").when(m == 1, "twitter").otherwise("youtube")


def posts_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored posts from ``events``: one post per event, sentiment from event type / value."""
    e = table(spark, sf_dir, "events")
    uid = F.col("user_id")
    et = F.col("event_type")
    return e.select(
        F.col("event_id").alias("post_id"),
        F.col("ts").alias("timestamp"),
        _source_of(uid).alias("source"),
        F.when(uid % 25 == 0, F.concat(F.lit("newsbot_"), uid.cast("string")))
         .otherwise(F.concat(F.lit("user_"), uid.cast("string"))).alias("author"),
        F.when(et.isin("purchase", "signup"), "positive").when(et == "error", "negative")
         .otherwise("neutral").alias("sentiment_label"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("sentiment_score"),
        F.regexp_replace("props", "[^0-9]", "").cast("int").alias("like_count"),
        (F.col("event_id") % 40 - 15).cast("int").alias("score"),
        F.array(
            F.struct(F.concat(F.lit("TEAM_"), (uid % 25).cast("string")).alias("name"),
                     F.lit("ORG").alias("type"), F.lit(0.9).alias("score")),
            F.struct(F.concat(F.lit("PLAYER_"), uid.cast("string")).alias("name"),
                     F.lit("PER").alias("type"), F.lit(0.8).alias("score")),
        ).alias("entities"),
    )


# Prefixes planted in document texts, by doc_id % 8 (see FIXTURES.md).
TEXT_PREFIXES = {
    0: "What a golazo #WorldCup2026 https://ex.am/p?q=1 ",
    1: "@ref_1 robbed by VAR &amp; a howler ",
    2: "www.ex.am/x bottled it, pure class from the gaffer  ",
    3: "GOAAAAAAAAAAL ",
    5: "#fifa world cup #other ",
    6: "12345 67890 !!! ",
}


SPAM_IDS = 10 ** 12


def texts_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw posts from ``documents`` with planted URLs, mentions, tags, slang and team names,
    whole texts always; short spam posts are extra rows with ids from SPAM_IDS on."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 8
    mood = F.floor(F.col("doc_id") / 8) % 5
    team_prefix = F.concat(F.lit("TEAM_"), (F.col("doc_id") % 25).cast("string"), F.lit(" v TEAM_"),
                           ((F.col("doc_id") + 3) % 25).cast("string"), F.lit(": pens after AET "),
                           F.when(mood == 0, "great win ").when(mood == 1, "terrible ").when(mood == 2, "great great terrible ").otherwise(""))
    prefix = F.when(k == 4, team_prefix)
    for key, p in TEXT_PREFIXES.items():
        prefix = prefix.when(k == key, F.lit(p))
    prefix = prefix.otherwise(F.lit(""))
    posts = d.withColumn("text", F.concat(prefix, F.col("text"))).withColumn("post", F.col("doc_id"))
    spam = d.filter(k == 3).withColumn("text", F.lit(TEXT_PREFIXES[3])).withColumn("post", F.col("doc_id") + SPAM_IDS)
    return posts.unionByName(spam).select(
        F.col("post").alias("doc_id"), "lang", "source",
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id"))).alias("ts"),
        F.concat(F.lit("user_"), (F.col("doc_id") % 150).cast("string")).alias("author"),
        "text",
    )


STAGE_BY_PRIORITY = {"1": "FINAL", "2": "QUARTER_FINALS", "3": "ROUND_OF_16",
                     "4": "Round of 16", "5": "Group Stage - 1"}
STATUS_BY_ORDERSTATUS = {"F": "FT", "O": "NS", "P": "1H"}


PART_BYTES = 4 << 20      # of the match tables' files to a partition


def _parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions by match: as many as the tables' files need, so that the sorts and groups of one task
    do not grow with the tables."""
    size = sum(file_bytes(spark, f"{sf_dir.rstrip('/')}/{t}.parquet") for t in ("orders", "lineitem"))
    return max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def _teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    # Kick-offs spread over January 2024 at minute resolution, so posts and matches overlap.
    kickoff = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
               + F.make_dt_interval(F.lit(0), F.lit(0), ((F.col("o_orderkey") * 37) % 43200).cast("int")))
    return j.select(
        "o_orderkey", kickoff.alias("o_orderdate"), "o_orderstatus", "o_orderpriority",
        F.concat(F.lit("TEAM_"), F.col("c_nationkey").cast("string")).alias("home"),
        F.concat(F.lit("TEAM_"), ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25)
                 .cast("string")).alias("away")).repartition(_parts(spark, sf_dir), "o_orderkey")


def _lookup(d: dict, key: Column) -> Column:
    out = None
    for k, v in d.items():
        out = (F.when(key == k, v) if out is None else out.when(key == k, v))
    return out


def _lines(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """Lines with their minute; dealt by match, unless they are grouped by more first."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_returnflag", "l_linestatus")
    if dealt:
        li = li.repartition(_parts(spark, sf_dir), "l_orderkey")
    return li.withColumn("minute", (1 + F.col("l_partkey") % 90).cast("int"))


def fixture_events_v(spark: SparkSession, sf_dir: str, events_for: list[str] | None = None) -> DataFrame:
    """Raw provider events (goals 'R', cards 'A', substitutions 'N') from lineitem; of fixtures that
    have a row of one of the statuses ``events_for``, if given (A07: the others are not fetched)."""
    li = _lines(spark, sf_dir)
    t = _teams(spark, sf_dir)
    if events_for:
        wanted = mf.status_map(F.coalesce(_lookup(STATUS_BY_ORDERSTATUS, F.col("o_orderstatus")), F.lit(""))).isin(events_for)
        t = t.withColumn("_wanted", F.max(wanted).over(Window.partitionBy("o_orderkey"))).filter("_wanted")
    t = t.select("o_orderkey", "home", "away")
    j = li.join(t, li.l_orderkey == t.o_orderkey)
    rf, pk, sk = F.col("l_returnflag"), F.col("l_partkey"), F.col("l_suppkey")
    p_next = F.concat(F.lit("P"), (sk + 1).cast("string"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return j.withColumn("pos", F.row_number().over(w)).select(       # numbered first: narrow rows are sorted
        F.col("l_orderkey").alias("fixture_id"), "pos",
        F.struct(F.when(sk % 2 == 0, F.col("home")).otherwise(F.col("away")).alias("name")).alias("team"),
        F.struct(F.concat(F.lit("P"), sk.cast("string")).alias("name")).alias("player"),
        F.struct(F.when(rf == "R", F.when(pk % 3 == 0, F.lit(None)).otherwise(p_next))
                 .when(rf == "N", p_next).alias("name")).alias("assist"),
        F.struct(F.col("minute").alias("elapsed")).alias("time"),
        F.when(rf == "R", "Goal").when(rf == "A", "Card").otherwise("subst").alias("type"),
        F.when(rf == "R", F.when(pk % 11 == 0, "Missed Penalty").otherwise("Normal Goal"))
         .when(rf == "A", F.when(pk % 13 == 0, "Second Yellow card")
               .when(F.col("l_linestatus") == "F", "Yellow Card").otherwise("Red Card"))
         .otherwise("Substitution 1").alias("detail"),
    )


def fixtures_raw_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw nested fixtures; scores counted from the goal lines, NULL when not started."""
    li = _lines(spark, sf_dir)
    goal = (F.col("l_returnflag") == "R") & (F.col("l_partkey") % 11 != 0)
    home = F.col("l_suppkey") % 2 == 0
    ht = F.col("minute") <= 45
    sc = li.groupBy("l_orderkey").agg(
        F.count_if(goal & home).cast("int").alias("hf"), F.count_if(goal & ~home).cast("int").alias("af"),
        F.count_if(goal & home & ht).cast("int").alias("hh"),
        F.count_if(goal & ~home & ht).cast("int").alias("ah"))
    t = _teams(spark, sf_dir)
    j = t.join(sc, t.o_orderkey == sc.l_orderkey, "left")
    short = _lookup(STATUS_BY_ORDERSTATUS, F.col("o_orderstatus"))
    started = short != "NS"

    def score(c):
        return F.when(started, F.coalesce(F.col(c), F.lit(0)))

    return j.select(
        F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"),
                 F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
                 F.struct(short.alias("short")).alias("status")).alias("fixture"),
        F.struct(_lookup(STAGE_BY_PRIORITY, F.substring("o_orderpriority", 1, 1)).alias("round"))
         .alias("league"),
        F.struct(F.struct(F.col("home").alias("name")).alias("home"),
                 F.struct(F.col("away").alias("name")).alias("away")).alias("teams"),
        F.struct(score("hf").alias("home"), score("af").alias("away")).alias("goals"),
        F.struct(F.struct(score("hh").alias("home"), score("ah").alias("away")).alias("halftime"),
                 F.struct(score("hf").alias("home"), score("af").alias("away")).alias("fulltime"))
         .alias("score"),
    )


def matches_v(spark: SparkSession, sf_dir: str, events_for=("FINISHED", "LIVE")) -> DataFrame:
    """Normalised matches (C02-C06 over the raw views). Events are attached to finished
    and live matches; scheduled ones have none. Stored once as a table (the normalised
    matches table of a pipeline) so every plan reads it instead of re-deriving it."""
    def build():
        return msrc.normalize_fixtures(fixtures_raw_v(spark, sf_dir), fixture_events_v(spark, sf_dir, list(events_for)),
                                       events_for=list(events_for))
    return materialized(spark, "matches_v", f"{sf_dir}|{','.join(events_for)}", build)


STAT_TYPES = ["Ball Possession", "Total Shots", "Shots on Goal", "Total passes", "Passes %",
              "Corner Kicks", "Goalkeeper Saves"]


def fixture_stats_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (fixture, team, type, value) statistics, values as provider strings."""
    li = _lines(spark, sf_dir, dealt=False)
    t = _teams(spark, sf_dir).select("o_orderkey", "home", "away")
    g = li.groupBy("l_orderkey", (F.col("l_suppkey") % 2).alias("side"), "l_linenumber").agg(
        F.max("l_quantity").cast("int").alias("q"))
    g = g.filter(F.col("l_linenumber").between(1, 7))
    typ = _lookup({i + 1: s for i, s in enumerate(STAT_TYPES)}, F.col("l_linenumber"))
    val = (F.when(F.col("l_orderkey") % 17 == 0, F.when(F.col("side") == 0, F.lit(None)).otherwise("n/a"))
           .when(F.col("l_linenumber") == 1, F.concat(F.col("q").cast("string"), F.lit("%")))
           .when(F.col("l_linenumber") == 5, (F.col("q") + 40).cast("string"))
           .otherwise(F.col("q").cast("string")))
    j = g.join(t, g.l_orderkey == t.o_orderkey)
    return j.select(F.col("l_orderkey").alias("fixture_id"),
                    F.when(F.col("side") == 0, F.col("home")).otherwise(F.col("away")).alias("team"),
                    typ.alias("type"), val.alias("value"))


def player_stats_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat per-fixture player statistics (the output shape of K04)."""
    li = _lines(spark, sf_dir)
    t = _teams(spark, sf_dir).select("o_orderkey", "home", "away")
    j = li.join(t, li.l_orderkey == t.o_orderkey)
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    pos = F.element_at(F.array(*[F.lit(x) for x in ("G", "D", "M", "F")]), (pk % 4 + 1).cast("int"))
    return j.select(
        F.col("l_orderkey").alias("fixture_id"), F.col("l_linenumber").alias("line"),
        F.concat(F.lit("P"), sk.cast("string")).alias("name"),
        F.when(sk % 2 == 0, F.col("home")).otherwise(F.col("away")).alias("team"),
        F.when(pk % 23 == 0, F.lit(None)).otherwise(pos).alias("position"),
        F.when(F.col("l_orderkey") % 19 == 0, F.lit(None))
         .otherwise(F.col("l_quantity").cast("int")).alias("minutes"),
        (F.lit(6.0) + (pk % 40) / 10.0).cast("string").alias("rating"),
        (pk % 3).cast("int").alias("goals"), F.floor((pk % 5) / 3).cast("int").alias("assists"),
        (pk % 7).cast("int").alias("shots_total"), (pk % 4).cast("int").alias("shots_on"),
        (pk % 60).cast("int").alias("passes_total"), (pk % 6).cast("int").alias("key_passes"),
        (50 + pk % 50).cast("string").alias("pass_accuracy"),
        (sk % 5).cast("int").alias("dribbles_attempted"), (sk % 3).cast("int").alias("dribbles_success"),
        (pk % 8).cast("int").alias("tackles"), (pk % 9).cast("int").alias("interceptions"),
        (pk % 10).cast("int").alias("duels_total"), (pk % 5).cast("int").alias("duels_won"),
        (pk % 4).cast("int").alias("aerial_duels_won"), (sk % 4).cast("int").alias("fouls_drawn"),
        (sk % 6).cast("int").alias("fouls_committed"),
        F.when(pk % 13 == 0, 1).otherwise(0).alias("yellow_cards"),
        F.when(pk % 97 == 0, 1).otherwise(0).alias("red_cards"),
    )


def adv_stats_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advanced team statistics from ``nation`` (odd keys lower-cased, one unknown team)."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    name = F.concat(F.lit("TEAM_"), k.cast("string"))
    rows = n.select(
        F.when(k % 2 == 1, F.lower(name)).otherwise(name).alias("team"),
        (k / 10.0).alias("xg"), ((24 - k) / 10.0).alias("xga"),
        ((40 + k) / 100.0).alias("possession_pct"),
        F.when(k % 5 == 0, F.lit(0.0)).otherwise(5.0 + k % 7).alias("ppda"),
        (100.0 + 3 * k).alias("progressive_passes"), (80.0 + 2 * k).alias("progressive_carries"),
        (150.0 + k).alias("pressures"))
    extra = n.filter(k == 0).select(
        F.lit("TEAM_99").alias("team"), F.lit(9.9).alias("xg"), F.lit(0.1).alias("xga"),
        F.lit(0.9).alias("possession_pct"), F.lit(1.0).alias("ppda"),
        F.lit(1.0).alias("progressive_passes"), F.lit(1.0).alias("progressive_carries"),
        F.lit(1.0).alias("pressures"))
    return rows.unionByName(extra)


def snapshots_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three live snapshots per started match; snapshot k holds events with minute <= 30k."""
    m = matches_v(spark, sf_dir).filter(F.col("status").isin("FINISHED", "LIVE"))
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")
    s = m.select("*", k)
    lim = F.col("k") * 30
    return s.select(
        "match_id", "home_team", "away_team", "utc_date", "status",
        (F.col("utc_date") + F.make_dt_interval(F.lit(0), F.lit(0), lim)).alias("snapshot_ts"),
        F.filter("goals", lambda g: g.minute <= lim).alias("goals"),
        F.filter("cards", lambda c: c.minute <= lim).alias("cards"),
    )


def external_players_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player table of another provider from ``supplier``: no team, some fields missing, players
    that no match knows (keys that 10 divides)."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.when(k % 10 == 0, "X").otherwise("P"), k.cast("string")).alias("name"),
        (k % 50 / 10.0).alias("xg"), (k % 30 / 10.0).alias("xa"), F.when(k % 3 != 0, k % 40 / 10.0).alias("npxg"),
        (k % 60 / 10.0).alias("key_passes"), F.when(k % 7 != 0, k % 90 / 10.0).alias("progressive_passes"),
        (k % 70 / 10.0).alias("progressive_carries"), (k % 200 / 10.0).alias("pressures"), (k % 100 / 1.0).alias("aerial_won_pct"))
