"""Team and player features from finished matches.

Team-match rows come from a home/away unpivot (no join). Recency weights 0.8^rank are
computed without a window over a whole (possibly hot) team: matches are counted per
(team, day), the suffix count of newer days comes from a window over those small
aggregates, and ranks are refined inside (team, day) only where the weight can still be
non-zero (0.8^r is exactly 0.0 in doubles from ``underflow_rank(0.8)`` on).
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fansignal.functions.common import safe_div
from fansignal.operators.topk import top_k_per_group

# Fixed values that must equal the reference.
RECENCY_DECAY = 0.8
ADVANCED_COLUMNS = ["xg", "xga", "xg_difference", "avg_possession", "avg_shots_on_target",
                    "shot_accuracy", "avg_pass_accuracy", "avg_corners", "avg_saves", "ppda",
                    "progressive_passes", "progressive_carries", "pressures"]

def underflow_rank(decay: float) -> int | None:
    """A rank from which decay ** rank is 0.0 in doubles (with a margin); None if none is."""
    return math.ceil(1075 * math.log(2) / -math.log(decay)) + 8 if 0 < decay < 1 else None


def team_match_rows(matches: DataFrame) -> DataFrame:
    """I01 + I02 + I08 + I09: each match -> a home row and an away row."""
    def side(s: str, o: str) -> Column:
        team = F.col(f"{s}_team")
        return F.struct(
            team.alias("team"), F.lit(s).alias("side"),
            F.coalesce(F.col(f"{s}_score_ft"), F.lit(0)).alias("gf"),
            F.coalesce(F.col(f"{o}_score_ft"), F.lit(0)).alias("ga"),
            F.coalesce(F.col(f"{s}_score_ht"), F.lit(0)).alias("ht_for"),
            F.coalesce(F.col(f"{o}_score_ht"), F.lit(0)).alias("ht_against"),
            F.when(F.col("winner") == ("HOME_TEAM" if s == "home" else "AWAY_TEAM"), 3)
             .when(F.col("winner") == "DRAW", 1).otherwise(0).alias("points"),
            F.size(F.filter(F.coalesce("cards", F.array()), lambda c: c["team"] == team)).alias("cards"),
            F.size(F.filter(F.coalesce("goals", F.array()), lambda g: g["team"] == team)).alias("event_goals"))
    rows = matches.select("match_id", "utc_date", "stage",
                          F.explode(F.array(side("home", "away"), side("away", "home"))).alias("r"))
    return rows.select("match_id", "utc_date", "stage", "r.*").filter(
        F.col("team").isNotNull() & (F.col("team") != ""))


def with_recency_weight(tm: DataFrame, decay: float = RECENCY_DECAY, weighted_only: bool = False) -> DataFrame:
    """weight = decay ** r, r = 0 for the team's most recent match (utc_date, match_id).
    ``weighted_only`` leaves out days of which every match has the weight 0.0, before the shuffle."""
    day = F.to_date("utc_date")
    tm = tm.withColumn("_day", day)
    per_day = tm.groupBy("team", "_day").agg(F.count(F.lit(1)).alias("_c"))
    wd = Window.partitionBy("team").orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    suffix = per_day.withColumn("_newer", F.coalesce(F.sum("_c").over(wd), F.lit(0))).drop("_c")
    zero_from = underflow_rank(decay)
    if weighted_only and zero_from is not None:
        suffix = suffix.filter(F.col("_newer") < zero_from)
    j = tm.join(suffix, ["team", "_day"])
    wl = Window.partitionBy("team", "_day").orderBy(F.col("utc_date").desc(), F.col("match_id").desc())
    r = F.col("_newer") + F.row_number().over(wl) - 1
    weight = F.pow(F.lit(decay), r.cast("double"))
    if zero_from is not None:
        weight = F.when(F.col("_newer") >= zero_from, F.lit(0.0)).otherwise(weight)
    return j.withColumn("weight", weight).drop("_day", "_newer")


def team_features(matches: DataFrame, decay: float = RECENCY_DECAY) -> DataFrame:
    """Per-team form features over the given (finished) matches, plus the 13
    advanced-stat columns at their 0.0 defaults (filled by ``merge_advanced_stats``).

    Counts and plain sums are partial aggregates. Only matches that can have a weight are shuffled
    and ranked: those of a team's newest days, as the others add exactly 0.0 to a weighted sum."""
    tm = team_match_rows(matches)
    agg = tm.filter(F.col("utc_date").isNotNull()).groupBy("team").agg(
        F.count(F.lit(1)).alias("matches_played"),
        F.avg(F.when(F.col("ga") == 0, 1.0).otherwise(0.0)).alias("clean_sheet_rate"),
        F.count_if((F.col("ht_for") < F.col("ht_against")) & (F.col("gf") > F.col("ga"))).alias("comeback_wins"),
        F.avg(F.col("cards").cast("double")).alias("avg_cards"),
        F.avg(F.col("event_goals").cast("double")).alias("avg_event_goals"),
        F.sum("points").cast("double").alias("total_points"))
    w = F.col("weight")
    form = with_recency_weight(tm, decay, weighted_only=True).groupBy("team").agg(
        F.sum(w).alias("_sw"),
        F.sum(F.col("points") * w).alias("_sp"), F.sum(F.col("gf") * w).alias("_sgf"),
        F.sum(F.col("ga") * w).alias("_sga"))
    agg = agg.join(form, "team")
    sw = F.col("_sw")
    return agg.select(
        "team", "matches_played",
        safe_div(F.col("_sp"), sw).alias("form_score"),
        safe_div(F.col("_sgf"), sw).alias("avg_goals_scored"),
        safe_div(F.col("_sga"), sw).alias("avg_goals_conceded"),
        (F.col("_sgf") - F.col("_sga")).alias("goal_difference"),
        "clean_sheet_rate", "comeback_wins", "avg_cards", "avg_event_goals", "total_points",
        *[F.lit(0.0).alias(c) for c in ADVANCED_COLUMNS])


ADV_SOURCES = {  # feature column -> columns of the advanced-stats table, first present wins
    "xg": ["xg"], "xga": ["xga"], "avg_possession": ["avg_possession", "possession_pct"],
    "avg_shots_on_target": ["avg_shots_on_target"], "shot_accuracy": ["shot_accuracy"],
    "avg_pass_accuracy": ["avg_pass_accuracy"], "avg_corners": ["avg_corners"],
    "avg_saves": ["avg_saves"], "ppda": ["ppda"], "progressive_passes": ["progressive_passes"],
    "progressive_carries": ["progressive_carries"], "pressures": ["pressures"],
}


def merge_advanced_stats(tf: DataFrame, adv: DataFrame, team_col: str = "team") -> DataFrame:
    """Exact team-name match first, else case-insensitive; unknown teams are skipped;
    each present (non-NULL) field overrides; xg_difference = xg - xga recomputed.

    The advanced rows are grouped by lower-cased name first (a name has a few spellings), so
    one join with the teams finds both kinds of match and ``tf`` is read once."""
    cols = set(adv.columns)
    new = [F.coalesce(*[F.col(s) for s in srcs if s in cols], F.lit(None).cast("double")).cast("double").alias(k)
           for k, srcs in ADV_SOURCES.items()]
    spellings = (adv.filter(F.col(team_col).isNotNull()).groupBy(F.lower(F.col(team_col)).alias("_low"))
                 .agg(F.array_sort(F.collect_list(F.struct(F.col(team_col).alias("name"), F.struct(*new).alias("v")))).alias("_adv")))
    j = tf.join(spellings, F.lower(F.col("team")) == F.col("_low"), "left")
    exact = F.try_element_at(F.filter("_adv", lambda x: x["name"] == F.col("team")), F.lit(1))
    pick = F.coalesce(exact, F.try_element_at("_adv", F.lit(1)))["v"]
    j = j.withColumn("_v", pick)
    j = j.withColumns({k: F.coalesce(F.col("_v")[k], F.col(k)) for k in ADV_SOURCES})
    # Unmatched teams keep 0.0 defaults, so xg - xga is right for every team.
    return j.withColumn("xg_difference", F.col("xg") - F.col("xga")).select(*tf.columns)


# ---- players -----------------------------------------------------------------

def player_events(matches: DataFrame) -> DataFrame:
    """Long player-event rows: goal (scorer), assist, yellow, red, other card."""
    base = matches.select("match_id", "utc_date", F.posexplode(F.coalesce("goals", F.array())).alias("pos", "g"))
    scorer = base.select("match_id", "utc_date", F.col("g.scorer").alias("player"), F.col("g.team").alias("team"),
                         F.lit("goal").alias("kind"), F.lit(0).alias("kind_rank"), "pos", F.lit(0).alias("role"))
    assist = base.select("match_id", "utc_date", F.col("g.assist").alias("player"), F.col("g.team").alias("team"),
                         F.lit("assist").alias("kind"), F.lit(0).alias("kind_rank"), "pos", F.lit(1).alias("role"))
    cards = matches.select("match_id", "utc_date", F.posexplode(F.coalesce("cards", F.array())).alias("pos", "c"))
    card_u = F.upper(F.coalesce(F.col("c.card"), F.lit("")))
    card = cards.select("match_id", "utc_date", F.col("c.player").alias("player"), F.col("c.team").alias("team"),
                        F.when(card_u.contains("YELLOW"), "yellow").when(card_u.contains("RED"), "red")
                        .otherwise("card").alias("kind"),
                        F.lit(1).alias("kind_rank"), "pos", F.lit(0).alias("role"))
    ev = scorer.unionByName(assist).unionByName(card)
    return ev.filter(F.col("player").isNotNull() & (F.col("player") != ""))


def player_features(matches: DataFrame) -> DataFrame:
    """Goals, assists, yellow / red cards, last team, distinct matches, rates."""
    ev = player_events(matches)
    k = F.col("kind")
    agg = ev.groupBy("player").agg(
        F.count_if(k == "goal").alias("goals"), F.count_if(k == "assist").alias("assists"),
        F.count_if(k == "yellow").alias("yellow_cards"), F.count_if(k == "red").alias("red_cards"),
        F.max_by("team", F.struct("utc_date", "match_id", "kind_rank", "pos", "role")).alias("team"),
        F.countDistinct("match_id").alias("matches"))
    m = F.col("matches")
    return agg.select(
        "player", "team", "goals", "assists", "yellow_cards", "red_cards", "matches",
        safe_div(F.col("goals").cast("double"), m).alias("goals_per_match"),
        safe_div((F.col("goals") + F.col("assists")).cast("double"), m).alias("goal_contributions_per_match"))


def top_players_per_team(pf: DataFrame, n: int = 3) -> DataFrame:
    """Top-n players of every team by contributions per match (player name breaks ties)."""
    return top_k_per_group(pf.filter(F.col("team").isNotNull()), ["team"],
                           [F.col("goal_contributions_per_match").desc(), F.col("player")], n,
                           salt_cols=["player"])


def standings(matches: DataFrame) -> DataFrame:
    """Group table per (stage, team) computed from results: P W D L GF GA GD Pts + rank."""
    tm = team_match_rows(matches)
    g = tm.groupBy("stage", "team").agg(
        F.count(F.lit(1)).alias("played"), F.count_if(F.col("points") == 3).alias("won"),
        F.count_if(F.col("points") == 1).alias("drawn"), F.count_if(F.col("points") == 0).alias("lost"),
        F.sum("gf").cast("long").alias("goals_for"), F.sum("ga").cast("long").alias("goals_against"),
        F.sum("points").cast("long").alias("pts"))
    g = g.withColumn("goal_diff", F.col("goals_for") - F.col("goals_against"))
    w = Window.partitionBy("stage").orderBy(F.col("pts").desc(), F.col("goal_diff").desc(), F.col("goals_for").desc())
    return g.withColumn("position", F.rank().over(w))


def top_scorers(pf: DataFrame, n: int = 20) -> DataFrame:
    """The n leading scorers (goals, then assists, then name); a distributed top-n."""
    top = pf.orderBy(F.col("goals").desc(), F.col("assists").desc(), F.col("player")).limit(n)
    return top.select("player", "team", "goals", "assists")


# ---- J01-J03 ------------------------------------------------------------------------

# Features z-scored across teams.
ZSCORE_FEATURES = ["avg_goals_scored", "avg_goals_conceded", "goal_difference", "xg", "xga", "xg_difference",
                   "avg_possession", "avg_shots_on_target", "avg_pass_accuracy", "progressive_passes",
                   "progressive_carries", "pressures"]


def normalize_features(tf: DataFrame, clip: float = 3.0) -> DataFrame:
    """J01 + J02: z-score over teams (population sigma; sigma 0 -> centred only), clipped,
    plus per-match columns. The statistics are one aggregate row broadcast to the teams."""
    cols = set(tf.columns)
    val = {c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in cols else F.lit(0.0)) for c in ZSCORE_FEATURES}
    stats = tf.agg(*[x for c in ZSCORE_FEATURES for x in (F.avg(val[c]).alias(f"_m_{c}"),
                                                           F.stddev_pop(val[c]).alias(f"_s_{c}"))])
    j = tf.crossJoin(F.broadcast(stats))
    z = {}
    for c in ZSCORE_FEATURES:
        centred = val[c] - F.col(f"_m_{c}")
        zz = F.when(F.col(f"_s_{c}") > 0, centred / F.col(f"_s_{c}")).otherwise(centred)
        z[c] = F.least(F.greatest(zz, F.lit(-clip)), F.lit(clip)).alias(f"{c}_z")
    mp = F.greatest(F.coalesce(F.col("matches_played"), F.lit(1)), F.lit(1))
    g = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in cols else F.lit(0.0)
    return j.select(*tf.columns, *z.values(),
                    g("avg_goals_scored").alias("goals_per_match"), g("avg_goals_conceded").alias("conceded_per_match"),
                    (g("xg") / mp).alias("xg_per_match"), (g("xga") / mp).alias("xga_per_match"),
                    g("avg_shots_on_target").alias("shots_per_match"))


def engineer_match_features(matches: DataFrame, tf: DataFrame, sentiment: DataFrame | None = None) -> DataFrame:
    """11 pair features per match (momentum, xG share, defence, pressing, stage, form x sentiment)."""
    from fansignal.functions.match import stage_weight
    t = tf.select("team", "xg", "avg_goals_conceded", "clean_sheet_rate", "avg_saves", "ppda", "form_score")
    if sentiment is not None:
        t = t.join(sentiment.select("team", "avg_sentiment"), "team", "left")
    else:
        t = t.withColumn("avg_sentiment", F.lit(None).cast("double"))
    h = t.select(*[F.col(c).alias("h_" + c) for c in t.columns])
    a = t.select(*[F.col(c).alias("a_" + c) for c in t.columns])
    j = (matches.join(h, F.col("home_team") == F.col("h_team"), "left")
                .join(a, F.col("away_team") == F.col("a_team"), "left"))

    def known(p):
        return F.col(p + "team").isNotNull()

    def get(p, c, d):  # dict.get(key, default): default only when the team is unknown
        return F.when(known(p), F.col(p + c)).otherwise(F.lit(d))

    def num(p, c, d):
        return F.coalesce(get(p, c, d), F.lit(0.0))
    hs = F.coalesce(F.col("h_avg_sentiment"), F.lit(0.5))
    as_ = F.coalesce(F.col("a_avg_sentiment"), F.lit(0.5))
    hx, ax = num("h_", "xg", 0.0), num("a_", "xg", 0.0)
    tot = hx + ax

    def defence(p):
        return ((1 - get(p, "avg_goals_conceded", 1.0) / 3) * 0.4 + get(p, "clean_sheet_rate", 0.0) * 0.4
                + get(p, "avg_saves", 0.0) / 10 * 0.2)

    def press(p):
        return 1 / F.greatest(get(p, "ppda", 10.0), F.lit(0.1))
    return j.select(
        "match_id", (hs - as_).alias("sentiment_momentum"),
        F.when(tot > 0, hx / tot).otherwise(F.lit(0.5)).alias("xg_share"),
        defence("h_").alias("home_defensive_score"), defence("a_").alias("away_defensive_score"),
        (defence("h_") - defence("a_")).alias("defensive_delta"),
        press("h_").alias("home_pressing_intensity"), press("a_").alias("away_pressing_intensity"),
        (press("h_") - press("a_")).alias("pressing_delta"),
        stage_weight(F.col("stage"), "engineer").alias("stage_weight"),
        (get("h_", "form_score", 1.0) * hs).alias("form_x_sentiment_home"),
        (get("a_", "form_score", 1.0) * as_).alias("form_x_sentiment_away"))


# ---- A15 / A16 feature snapshots ------------------------------------------------------

SNAPSHOT_FIELDS = ["form_score", "avg_goals_scored", "avg_goals_conceded", "goal_difference", "clean_sheet_rate",
                   "comeback_wins", "xg", "xga", "avg_possession", "shot_accuracy", "avg_pass_accuracy", "ppda",
                   "avg_sentiment", "positive_ratio", "negative_ratio", "post_count"]


def feature_snapshot(tf: DataFrame, sentiment: DataFrame, event_time: Column) -> DataFrame:
    """Team features joined with team sentiment, defaults for missing values, stamped
    with ``event_time`` (epoch seconds) — one append-only snapshot row per team."""
    j = tf.join(sentiment.select("team", "avg_sentiment", "positive_ratio", "negative_ratio", "post_count"),
                "team", "left")
    defaults = {"avg_sentiment": 0.5}
    return j.select(F.col("team").alias("team_name"), event_time.cast("double").alias("event_time"),
                    *[F.coalesce(F.col(c).cast("double"), F.lit(defaults.get(c, 0.0))).alias(c)
                      for c in SNAPSHOT_FIELDS])


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """A16 (online view): the newest snapshot per team (``max_by`` — no window)."""
    g = snapshots.groupBy("team_name").agg(F.max_by(F.struct(*[c for c in snapshots.columns if c != "team_name"]),
                                                    F.col("event_time")).alias("s"))
    return g.select("team_name", "s.*")
