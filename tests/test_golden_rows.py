"""Hand-typed rows for operators without a query of their own, and spam, shingle and wide-table cases."""
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from fansignal.functions import scoring as sc
from fansignal.operators import dedup as dd
from fansignal.operators import enrich as en
from fansignal.operators import model as mdl
from fansignal.operators import stats as st
from fansignal.streaming import pipeline as sp


def test_empty_text_is_neutral(spark):
    rows = spark.createDataFrame([("",), (None,), ("great win",), ("great terrible win",), ("awful",)], "t string").select(sc.lexicon_score(F.col("t")).alias("s"))
    assert [(r.s.sentiment_label, round(r.s.sentiment_score, 6)) for r in rows.collect()] == [
        ("neutral", 0.5), ("neutral", 0.5), ("positive", 1.0), ("positive", 0.666667), ("negative", 0.0)]


def test_model_output_defaults(spark):
    raw = ['{"sentiment_label": "positive", "sentiment_score": 0.9, "confidence": 0.8, "entities": [{"name": "A", "type": "TEAM", "score": 0.5}], "reasoning": "r"}',
           "{}", '{"sentiment_score": 0.1}']
    got = [r.p for r in spark.createDataFrame([(x,) for x in raw], "t string").select(sc.parse_model_output(F.col("t")).alias("p")).collect()]
    assert (got[0].sentiment_label, got[0].sentiment_score, got[0].confidence, got[0].entities[0].name, got[0].reasoning) == ("positive", 0.9, 0.8, "A", "r")
    assert tuple(got[1]) == ("neutral", 0.5, 1.0, [], "")
    assert (got[2].sentiment_label, got[2].sentiment_score) == ("neutral", 0.1)


def test_fallback_scorer(spark):
    df = spark.createDataFrame([("great", None), ("great", 0.25)], "t string, m double")
    primary = F.when(F.col("m").isNotNull(), F.struct(F.lit("negative").alias("sentiment_label"), F.col("m").alias("sentiment_score")))
    got = [tuple(r.s) for r in df.select(en.with_fallback(primary, sc.lexicon_score(F.col("t"))).alias("s")).collect()]
    assert got == [("positive", 1.0), ("negative", 0.25)]


def test_labels_pass_through(spark):
    df = spark.createDataFrame([("POSITIVE",), ("neutral",), ("LABEL_2",), (None,)], "x string")
    assert [r[0] for r in df.select(sc.map_label(F.col("x"))).collect()] == ["positive", "neutral", "LABEL_2", None]


def test_scored_post_defaults(spark):
    df = spark.createDataFrame([("hi", None, "x1"), ("yo", "reddit", None)], "text string, source string, id string")
    at = F.lit("2026-06-11 00:00:00").cast("timestamp")
    got = [r.asDict() for r in en.scored_post_projection(df, at).collect()]
    assert [(g["source"], g["source_id"], g["time_decay_weight"], g["engagement_weight"], g["entities"], g["author"]) for g in got] == [
        ("unknown", "x1", 1.0, 1.0, [], None), ("reddit", None, 1.0, 1.0, [], None)]


def test_groups_without_posts(spark):
    agg = spark.createDataFrame([("A", 0.9, 0.8, 1.0, 0.0, 0.0, 4)],
                                "team string, avg_sentiment double, weighted_sentiment double, positive_ratio double, negative_ratio double, neutral_ratio double, post_count long")
    got = {r.team: tuple(r)[1:] for r in en.with_empty_defaults(agg, spark.createDataFrame([("A",), ("B",)], "team string"), ["team"]).collect()}
    assert got == {"A": (0.9, 0.8, 1.0, 0.0, 0.0, 4), "B": (0.5, 0.5, 0.0, 0.0, 0.0, 0)}


def test_prediction_explanation(spark):
    row = [("Brazil", "Iran", 61.25, 20.0, 18.75, 2.5, 1.25, 0.6, 0.4567)]
    df = spark.createDataFrame(row, "home_team string, away_team string, home_win double, draw double, away_win double, home_form double, away_form double, "
                                    "home_sentiment double, away_sentiment double")
    assert en.prediction_explanation(df).first().explanation == (
        "Brazil vs Iran: home 61.3%, draw 20.0%, away 18.8%; form 2.50 vs 1.25; sentiment 0.600 vs 0.457")


def test_player_statistics_flatten(spark):
    response = {"team": {"name": "Brazil"}, "players": [
        {"player": {"name": "Ana"}, "statistics": [{"games": {"position": "F", "minutes": 90, "rating": "7.9"}, "goals": {"total": 2, "assists": None},
                                                    "shots": {"total": 5, "on": 3}, "passes": {"total": 30, "key": 4, "accuracy": "81"},
                                                    "dribbles": {"attempts": 6, "success": 4}, "tackles": {"total": 1, "interceptions": 2},
                                                    "duels": {"total": 9, "won": 5, "aerial_won": 1}, "fouls": {"drawn": 2, "committed": 1},
                                                    "cards": {"yellow": 1, "red": 0}}, {"games": {"minutes": 5}}]},
        {"player": {"name": "Bea"}, "statistics": [{"games": {"position": None, "minutes": None, "rating": None}}]}]}
    schema = ("team struct<name:string>, players array<struct<player:struct<name:string>, statistics:array<struct<games:struct<position:string,minutes:int,rating:string>, "
              "goals:struct<total:int,assists:int>, shots:struct<total:int,on:int>, passes:struct<total:int,key:int,accuracy:string>, "
              "dribbles:struct<attempts:int,success:int>, tackles:struct<total:int,interceptions:int>, duels:struct<total:int,won:int,aerial_won:int>, "
              "fouls:struct<drawn:int,committed:int>, cards:struct<yellow:int,red:int>>>>>")
    raw = spark.createDataFrame([(json.dumps(response),)], "j string").select(F.from_json("j", schema).alias("x")).select("x.*")
    ana, bea = st.flatten_player_stats(raw).orderBy("name").collect()
    assert len(ana) == 23 and tuple(ana) == ("Ana", "Brazil", "F", 90, "7.9", 2, 0, 5, 3, 30, 4, "81", 6, 4, 1, 2, 9, 5, 1, 2, 1, 1, 0)
    assert tuple(bea) == ("Bea", "Brazil", None, 0, None, 0, 0, 0, 0, 0, 0, None, *[0] * 11)


def test_preferred_prediction_or_fallback(spark):
    schema = "match_id int, home_win double, draw double, away_win double, source string"
    local = spark.createDataFrame([(i, 50.0, 30.0, 20.0, "local") for i in (1, 2, 3)], schema)
    remote = spark.createDataFrame([(1, 40.0, 35.0, 25.0, "remote"), (2, None, 35.0, 25.0, "remote")], schema)
    got = [tuple(r) for r in mdl.with_fallback(remote, local, ["match_id"]).orderBy("match_id").collect()]
    assert got == [(1, 40.0, 35.0, 25.0, "remote"), (2, 33.0, 34.0, 33.0, "remote"), (3, 50.0, 30.0, 20.0, "local")]


def test_json_value(spark):
    df = spark.createDataFrame([("reddit", "a \"quoted\" text", None, 3)], "source string, text string, author string, score int")
    value = sp.to_json_value(df).first().value
    assert json.loads(value) == {"source": "reddit", "text": 'a "quoted" text', "score": 3}


def test_training_needs_five_labelled_matches(spark):
    prof = mdl.team_profile(spark.createDataFrame([("A", 1.0)], "team string, form_score double"))
    m = spark.createDataFrame([(i, "A", "B", "DRAW" if i < 5 else None) for i in range(9)], "match_id int, home_team string, away_team string, winner string")
    assert mdl.training_frame(m.filter("match_id < 4"), prof) is None
    assert mdl.training_frame(m.filter("match_id > 3"), prof) is None          # one label, four without
    assert mdl.training_frame(m, prof).count() == 5


def test_predictions_fall_back_to_the_last_finished(spark):
    rows = spark.createDataFrame([(i, f"2026-06-{i:02d}") for i in range(1, 13)], "match_id int, utc_date string")
    some = mdl.predictions_to_show(rows, rows, 3, 2).collect()
    assert [r.match_id for r in some] == [1, 2, 3]
    none = mdl.predictions_to_show(rows.filter("false"), rows, 3, 2).collect()
    assert sorted(r.match_id for r in none) == [11, 12]


def test_leaderboard_ranks_with_ties(spark):
    prof = spark.createDataFrame([("C", 2.0), ("A", 1.0), ("B", 1.0), ("D", 0.0), (None, 5.0)], "team string, form_score double")
    got = mdl.leaderboard(mdl.reference_scorer(), mdl.team_profile(prof), block_size=2).orderBy("rank").collect()
    assert [(r.rank, r.team) for r in got] == [(1, "C"), (2, "A"), (3, "B"), (4, "D")]


def test_prediction_cards(spark):
    pred = spark.createDataFrame([(1, "A", "Z", 50.0, 30.0, 20.0)], "match_id int, home_team string, away_team string, home_win double, draw double, away_win double")
    teams = spark.createDataFrame([("A", 2.0, 1.5, 0.5, 3.0, 0.25, 1, 0.7, 0.6)],
                                  "team string, form_score double, avg_goals_scored double, avg_goals_conceded double, goal_difference double, clean_sheet_rate double, "
                                  "comeback_wins long, avg_sentiment double, positive_ratio double")
    top = spark.createDataFrame([("A", 2, "y", 1, 0, 0.5), ("A", 1, "x", 2, 1, 1.5), ("B", 1, "q", 0, 0, 0.0)],
                                "team string, rank int, player string, goals long, assists long, goal_contributions_per_match double")
    r = mdl.prediction_cards(pred, teams, top).first()
    assert (r.home_form_score, r.home_comeback_wins, r.home_avg_sentiment, [p.player for p in r.home_players]) == (2.0, 1, 0.7, ["x", "y"])
    assert (r.away_form_score, r.away_comeback_wins, r.away_avg_sentiment, r.away_players) == (0.0, 0, 0.5, [])


@pytest.mark.parametrize("column,field", [
    ("xG", "xg"), ("Team xG", "xg"), ("xG_total", "xg"), ("('Expected', 'xG')", "xg"), ("Expected xG", "xg"), ("xG Sum", "xg"),
    ("xGA", "xga"), ("xG against", "xga"), ("npxG", None), ("non-penalty xG", None), ("xG per 90", None), ("xG/90", None), ("maxg", None)])
def test_team_xg_columns(column, field):
    assert st.column_field(column, st.TEAM_FIELDS) == field


def test_team_xg_reaches_the_table(spark):
    df = spark.createDataFrame([("Brazil", "1.5", "0.5")], "Squad string, `('Expected', 'xG')` string, `('Expected', 'xGA')` string")
    r = st.canonicalize_wide_tables([df]).first()
    assert (r.team, r.xg, r.xga) == ("Brazil", 1.5, 0.5)


# ---- F05 against plain Python -------------------------------------------------------

def python_preprocess(rows, slang):
    def shingles(t):
        w = t.lower().split()
        return set(w) if len(w) < 3 else {" ".join(w[i:i + 3]) for i in range(len(w) - 2)}
    kept = []
    for i, ts, author, score, text in sorted(rows, key=lambda r: (r[1], r[0])):
        t = text or ""
        if re.search(r"(?i)bot$|^auto|^mod|_bot$|newsbot|feedbot", author or "") or (score or 0) < -10 or (re.search(r"(.)\1{8,}", t) and len(t.split()) < 3):
            continue
        t = re.sub(r"&[a-zA-Z]+;|&#\d+;", " ", t)
        t = re.sub(r"https?://\S+|www\.\S+", "", t)
        t = re.sub(r"@\w+", "", t).replace("#", "")
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        for word, new in slang:
            t = re.sub(rf"(?i)\b{word}\b", new, t)
        t = re.sub(r"\s{2,}", " ", t).strip()
        letters = sum(c.isalpha() for c in t)
        if len(t.split()) < 4 or letters / max(len(t), 1) < 0.4 or sum(c.isascii() and c.isalpha() for c in t) / max(len(t), 1) <= 0.7:
            continue
        kept.append((i, t, shingles(t)))
    # dropped if any earlier cleaned post is similar
    return [(i, t) for n, (i, t, s) in enumerate(kept) if not any(len(s & o) / len(s | o) >= 0.8 for _, _, o in kept[:n])]


def test_preprocess_against_plain_python(spark):
    from tests.test_golden import SLANG
    base = "the keeper made a howler in the final and the lad bottled it before the pens were even taken by anyone"
    rows = [(1, 5, "fan", 0, base), (2, 4, "fan", 0, base + " today"), (3, 6, "newsbot_1", 0, base + " x y z"), (4, 1, "fan", -11, "a low scored but fine text"),
            (5, 2, "fan", None, "GOAAAAAAAAAAL now"), (6, 3, "fan", 3, "see https://a.b/c &amp; www.x.y about the café final @ref tonight"),
            (7, 7, None, 0, "too short"), (8, 8, "fan", 0, "1234 5678 9012 3456 7890"), (9, 9, "fan", 0, None), (10, 10, "fan", 0, "ÀÉÎ õü ñandú ça va très bien là"),
            (11, 11, "fan", 0, "Ωμέγα και άλλες λέξεις εδώ πάλι"), (12, 12, "fan", 0, "see about the cafe final tonight"), (13, 13, "Modric", 0, "a fine text by a player")]
    df = spark.createDataFrame(rows, "post_id int, s int, author string, score int, text string").withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
    got = sorted((r.post_id, r.text) for r in en.preprocess(df, F.lit("2026-06-11").cast("timestamp")).collect())
    assert got == sorted(python_preprocess(rows, SLANG))


def test_keep_first_reads_the_texts_once_for_shingles(spark):
    df = spark.createDataFrame([(1, 1, "one two three four five"), (2, 2, "ONE two three four five"), (3, 3, "one two three four six"), (4, 4, ""), (5, 5, None), (6, 6, "one")],
                               "doc_id int, ts int, text string")
    d = dd.keep_first(df)
    assert sorted(r.doc_id for r in d.collect()) == [1, 3, 4, 5, 6]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 0        # shingles were stored
