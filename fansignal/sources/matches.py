"""Match documents: raw fixture normalisation, scans, upserts and event fan-out.

All operators are DataFrame -> DataFrame. Event arrays are built per fixture with
``collect_list`` after a shuffle on fixture id; one match holds a bounded number of
events, so no group grows with the data.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fansignal.functions import match as mf

LIVE_STATUSES = ["LIVE", "1H", "2H", "HT"]
UPCOMING_STATUSES = ["SCHEDULED", "TIMED"]


def event_arrays(events: DataFrame) -> DataFrame:
    """Raw fixture events -> one row per fixture with goals / cards / substitutions.

    ``events``: fixture_id, pos, team.name, player.name, assist.name, time.elapsed, type, detail.
    Goals are type 'Goal' except detail 'Missed Penalty'; arrays keep the provider order (pos).
    """
    e = events.select(
        "fixture_id", "pos", "type", "detail",
        F.col("time.elapsed").cast("int").alias("minute"),
        F.coalesce(F.col("team.name"), F.lit("")).alias("team"),
        F.col("player.name").alias("player"), F.col("assist.name").alias("assist"))
    is_goal = (F.col("type") == "Goal") & (F.coalesce(F.col("detail"), F.lit("")) != "Missed Penalty")
    kind = F.when(is_goal, "g").when(F.col("type") == "Card", "c").when(F.col("type") == "subst", "s")
    # one list a fixture; a card has no second player, so it is ordered without
    agg = e.groupBy("fixture_id").agg(F.array_sort(F.collect_list(F.when(kind.isNotNull(), F.struct(
        "pos", "minute", "team", "player", F.when(kind != "c", F.col("assist")).alias("assist"), "detail", kind.alias("kind"))))).alias("_e"))

    def of(kind, **fields):
        return F.transform(F.filter("_e", lambda x: x["kind"] == kind),
                           lambda x: F.struct(*[x[c].alias(k) for k, c in ({"minute": "minute", "team": "team"} | fields).items()]))
    return agg.select(
        "fixture_id",
        of("g", scorer="player", assist="assist", type="detail").alias("goals"),
        of("c", player="player", card="detail").alias("cards"),
        of("s", player_out="player", player_in="assist").alias("substitutions"))


def normalize_fixtures(fixtures: DataFrame, events: DataFrame | None = None,
                       events_for: list[str] | None = ("FINISHED",)) -> DataFrame:
    """C02 + C06 + A07: flatten raw fixtures into match rows.

    Events are attached only to fixtures whose mapped status is in ``events_for``
    (the full sync fetches events for finished matches only); others get empty arrays.
    """
    m = fixtures.select(
        F.col("fixture.id").cast("long").alias("match_id"),
        mf.status_map(F.coalesce(F.col("fixture.status.short"), F.lit(""))).alias("status"),
        F.coalesce(F.col("league.round"), F.lit("")).alias("stage"),
        F.col("fixture.date").alias("utc_date"),
        F.coalesce(F.col("teams.home.name"), F.lit("")).alias("home_team"),
        F.coalesce(F.col("teams.away.name"), F.lit("")).alias("away_team"),
        F.col("score.fulltime.home").cast("int").alias("home_score_ft"),
        F.col("score.fulltime.away").cast("int").alias("away_score_ft"),
        F.col("score.halftime.home").cast("int").alias("home_score_ht"),
        F.col("score.halftime.away").cast("int").alias("away_score_ht"),
        F.timestamp_seconds(F.col("fixture.timestamp")).alias("last_updated"),
    ).withColumn("winner", mf.winner(F.col("home_score_ft"), F.col("away_score_ft")))
    empty = {
        "goals": F.array().cast("array<struct<minute:int,team:string,scorer:string,assist:string,type:string>>"),
        "cards": F.array().cast("array<struct<minute:int,team:string,player:string,card:string>>"),
        "substitutions": F.array().cast(
            "array<struct<minute:int,team:string,player_out:string,player_in:string>>"),
    }
    if events is None:
        return m.select("*", *[v.alias(k) for k, v in empty.items()])
    arr = event_arrays(events).withColumnRenamed("fixture_id", "match_id")
    wanted = F.col("status").isin(list(events_for)) if events_for else F.lit(True)
    j = m.join(arr, "match_id", "left")
    return j.select(*m.columns, *[F.when(wanted, F.coalesce(F.col(k), v)).otherwise(v).alias(k)
                                  for k, v in empty.items()])


def normalize_match(matches: DataFrame, normalize_separators: bool = False) -> DataFrame:
    """Impute NULL scores as 0, extra-time / penalty flags, stage weight, team aliases."""
    out = matches
    for c in ("home_score_ft", "away_score_ft", "home_score_ht", "away_score_ht"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return (out
            .withColumn("went_to_et", mf.went_to_extra_time(F.col("stage")))
            .withColumn("went_to_pens", mf.went_to_penalties(F.col("stage")))
            .withColumn("stage_weight", mf.stage_weight(F.col("stage"), "normalize", normalize_separators))
            .withColumn("home_team", mf.normalize_team_name(F.col("home_team")))
            .withColumn("away_team", mf.normalize_team_name(F.col("away_team"))))


# ---- scans (A08-A12) -------------------------------------------------------

def finished_matches(matches: DataFrame, limit: int | None = None) -> DataFrame:
    """Status FINISHED, kickoff ascending (match_id breaks ties). ``limit`` is the
    reference's page size; by default the whole table is used."""
    out = matches.filter(F.col("status") == "FINISHED")
    if limit is not None:
        out = out.orderBy("utc_date", "match_id").limit(limit)
    return out


def scheduled_matches(matches: DataFrame, limit: int | None = None) -> DataFrame:
    """SCHEDULED or TIMED."""
    out = matches.filter(F.col("status").isin(UPCOMING_STATUSES))
    if limit is not None:
        out = out.orderBy("utc_date", "match_id").limit(limit)
    return out


def live_fixtures(fixtures: DataFrame) -> DataFrame:
    """A10: raw fixtures whose provider status is LIVE / 1H / 2H / HT (one IN filter)."""
    return fixtures.filter(F.col("fixture.status.short").isin(LIVE_STATUSES))


def fixtures_by_status(fixtures: DataFrame, status: str | None = None) -> DataFrame:
    """Optional provider-status filter."""
    return fixtures if status is None else fixtures.filter(F.col("fixture.status.short") == status)


def fixture_events(events: DataFrame, fixture_id: int) -> DataFrame:
    """Events of one fixture, in provider order."""
    return events.filter(F.col("fixture_id") == fixture_id).orderBy("pos")


def events_of(events: DataFrame, ids: DataFrame, key: str = "fixture_id") -> DataFrame:
    """A12 for many fixtures at once: the events of the given ids (a semi join)."""
    return events.join(ids.select(key), key, "left_semi")


def upsert_latest(docs: DataFrame, key: str = "match_id", order_col: str = "last_updated") -> DataFrame:
    """Last write wins per key (batch form of an index upsert)."""
    w = Window.partitionBy(key).orderBy(F.col(order_col).desc_nulls_last())
    return docs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


# ---- event fan-out (B11-B13) -----------------------------------------------

def match_event_rows(matches: DataFrame, event_time=None) -> DataFrame:
    """Goals and cards -> one event row each, with the match header columns."""
    ts = event_time if event_time is not None else F.current_timestamp()
    head = ["match_id", "home_team", "away_team", "utc_date"]
    goals = matches.select(*head, F.posexplode("goals").alias("pos", "g")).select(
        F.lit("goal").alias("event_type"), *head, ts.alias("timestamp"), "pos",
        F.col("g.minute").alias("minute"), F.col("g.team").alias("team"),
        F.col("g.scorer").alias("scorer"), F.col("g.assist").alias("assist"),
        F.col("g.type").alias("type"), F.lit(None).cast("string").alias("player"),
        F.lit(None).cast("string").alias("card"))
    cards = matches.select(*head, F.posexplode("cards").alias("pos", "c")).select(
        F.lit("card").alias("event_type"), *head, ts.alias("timestamp"), "pos",
        F.col("c.minute").alias("minute"), F.col("c.team").alias("team"),
        F.lit(None).cast("string").alias("scorer"), F.lit(None).cast("string").alias("assist"),
        F.lit(None).cast("string").alias("type"), F.col("c.player").alias("player"),
        F.col("c.card").alias("card"))
    return goals.unionByName(cards)


def snapshot_changes(snapshots: DataFrame, key: str = "match_id", order_col: str = "snapshot_ts") -> DataFrame:
    """Keep a snapshot only if it has more goals or more cards than the previous
    snapshot of the same match (the first snapshot compares against empty)."""
    w = Window.partitionBy(key).orderBy(order_col)
    prev_g = F.coalesce(F.lag(F.size("goals")).over(w), F.lit(0))
    prev_c = F.coalesce(F.lag(F.size("cards")).over(w), F.lit(0))
    return (snapshots.withColumn("_pg", prev_g).withColumn("_pc", prev_c)
            .filter((F.size("goals") > F.col("_pg")) | (F.size("cards") > F.col("_pc")))
            .drop("_pg", "_pc"))


EVENT_KEY = ["match_id", "event_type", "minute", "team", "scorer", "player", "type", "card"]


def new_events_only(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Events of ``current`` not already present in ``previous`` (null-safe anti join)."""
    cond = [current[c].eqNullSafe(previous[c]) for c in EVENT_KEY]
    return current.join(previous.select(*EVENT_KEY), cond, "left_anti")
