"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator row of SURVEY §2.

Every query reads the whole given tables (no id subsets or row caps); limits appear only
where a top-k is the feature. Floating outputs are rounded through a decimal
(``fixed``) so results do not depend on summation order.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fansignal.functions.common import fixed
from fansignal.operators import sentiment as sent
from fansignal.sources import fixtures as fx

ALL_HOURS = 24 * 31  # the posts span January 2024; the range filter covers all of it


def _round(df: DataFrame, places: dict[str, int] | None = None) -> DataFrame:
    places = places or {}
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            p = places.get(f.name, 6)
            out.append(fixed(f.name, p).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def g08_spikes(spark: SparkSession, sf_dir: str, interval: str = "1h") -> DataFrame:
    posts = fx.posts_v(spark, sf_dir)
    s = sent.detect_spikes(posts, fx.as_of_col(), interval=interval, hours_back=ALL_HOURS)
    return _round(s, {"avg_score": 4, "deviation_sigmas": 2})


def g08_spikes_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g08_spikes(spark, sf_dir, "15m")


QUERIES = {
    "g08_spikes": g08_spikes,
    "g08_spikes_15m": g08_spikes_15m,
}


# ---- match normalisation and scans (A06-A11, B11-B13, C01-C10) ---------------
from fansignal.sources import matches as msrc  # noqa: E402
from fansignal.functions import match as mfn  # noqa: E402
from fansignal.operators import features as feat  # noqa: E402


def c01_status_map(spark, sf_dir):
    raw = fx.fixtures_raw_v(spark, sf_dir)
    return (raw.select(F.col("fixture.status.short").alias("short"),
                       mfn.status_map(F.col("fixture.status.short")).alias("status"))
            .groupBy("short", "status").agg(F.count(F.lit(1)).alias("fixtures")))


def c02_matches(spark, sf_dir):
    m = fx.matches_v(spark, sf_dir)
    return m.select("match_id", "status", "stage", "utc_date", "home_team", "away_team",
                    "home_score_ft", "away_score_ft", "home_score_ht", "away_score_ht", "winner",
                    F.size("goals").alias("n_goals"), F.size("cards").alias("n_cards"),
                    F.size("substitutions").alias("n_subs"))


def c03_goals(spark, sf_dir):
    m = fx.matches_v(spark, sf_dir)
    return m.select("match_id", F.posexplode("goals").alias("pos", "g")).select(
        "match_id", "pos", "g.minute", "g.team", "g.scorer", "g.assist", "g.type")


def c04_cards(spark, sf_dir):
    m = fx.matches_v(spark, sf_dir)
    return m.select("match_id", F.posexplode("cards").alias("pos", "c")).select(
        "match_id", "pos", "c.minute", "c.team", "c.player", "c.card")


def c05_substitutions(spark, sf_dir):
    m = fx.matches_v(spark, sf_dir)
    return m.select("match_id", F.posexplode("substitutions").alias("pos", "s")).select(
        "match_id", "pos", "s.minute", "s.team", "s.player_out", "s.player_in")


def c07_normalize_match(spark, sf_dir):
    m = msrc.normalize_match(fx.matches_v(spark, sf_dir))
    return m.select("match_id", "home_team", "away_team", "home_score_ft", "away_score_ft",
                    "home_score_ht", "away_score_ht", "went_to_et", "went_to_pens", "stage_weight",
                    mfn.stage_weight(F.col("stage"), "engineer").alias("stage_weight_engineer"),
                    mfn.stage_weight(F.col("stage"), "normalize", True).alias("stage_weight_normalized"))


def a08_finished(spark, sf_dir):
    return msrc.finished_matches(fx.matches_v(spark, sf_dir)).select("match_id", "utc_date", "home_team", "away_team")


def a09_scheduled(spark, sf_dir):
    return msrc.scheduled_matches(fx.matches_v(spark, sf_dir)).select("match_id", "utc_date", "home_team", "away_team")


def a10_live(spark, sf_dir):
    raw = fx.fixtures_raw_v(spark, sf_dir)
    return msrc.live_fixtures(raw).select(F.col("fixture.id").alias("match_id"),
                                          F.col("fixture.status.short").alias("short"))


def a11_by_status(spark, sf_dir):
    raw = fx.fixtures_raw_v(spark, sf_dir)
    return msrc.fixtures_by_status(raw, "FT").select(F.col("fixture.id").alias("match_id"))


def _snap_summary(df):
    return df.select("match_id", "snapshot_ts", F.size("goals").alias("n_goals"), F.size("cards").alias("n_cards"))


def a06_upsert_latest(spark, sf_dir):
    return _snap_summary(msrc.upsert_latest(fx.snapshots_v(spark, sf_dir), "match_id", "snapshot_ts"))


def b11_snapshot_changes(spark, sf_dir):
    return _snap_summary(msrc.snapshot_changes(fx.snapshots_v(spark, sf_dir)))


def _events_cols(df):
    return df.select("event_type", "match_id", "pos", "minute", "team", "scorer", "assist", "type", "player", "card")


def b12_event_fanout(spark, sf_dir):
    m = msrc.finished_matches(fx.matches_v(spark, sf_dir))
    return _events_cols(msrc.match_event_rows(m, fx.as_of_col()))


def b13_new_events(spark, sf_dir):
    s = fx.snapshots_v(spark, sf_dir)
    cur = msrc.match_event_rows(s.filter("snapshot_ts = utc_date + INTERVAL 90 MINUTES"), fx.as_of_col())
    prev = msrc.match_event_rows(s.filter("snapshot_ts = utc_date + INTERVAL 60 MINUTES"), fx.as_of_col())
    return _events_cols(msrc.new_events_only(cur, prev))


# ---- team and player features (I01-I19) -------------------------------------

def _finished(spark, sf_dir):
    return msrc.finished_matches(fx.matches_v(spark, sf_dir))


def i01_team_rows(spark, sf_dir):
    tm = feat.team_match_rows(_finished(spark, sf_dir))
    return tm.select("match_id", "team", "side", "gf", "ga", "ht_for", "ht_against", "points", "cards", "event_goals")


def i03_recency_weights(spark, sf_dir):
    tm = feat.with_recency_weight(feat.team_match_rows(_finished(spark, sf_dir)))
    return _round(tm.select("team", "match_id", "weight"), {"weight": 9})


def i04_team_features(spark, sf_dir):
    return _round(feat.team_features(_finished(spark, sf_dir)))


def i11_merge_advanced(spark, sf_dir):
    tf = feat.team_features(_finished(spark, sf_dir))
    out = feat.merge_advanced_stats(tf, fx.adv_stats_v(spark, sf_dir))
    return _round(out.select("team", "matches_played", "form_score", *feat.ADVANCED_COLUMNS))


def i12_player_features(spark, sf_dir):
    return _round(feat.player_features(_finished(spark, sf_dir)))


def i17_top_players(spark, sf_dir):
    pf = feat.player_features(_finished(spark, sf_dir))
    return _round(feat.top_players_per_team(pf, 3).select("team", "rank", "player", "goals", "assists",
                                                          "goal_contributions_per_match"))


def i18_standings(spark, sf_dir):
    return feat.standings(_finished(spark, sf_dir))


def i19_top_scorers(spark, sf_dir):
    return feat.top_scorers(feat.player_features(_finished(spark, sf_dir)), 20)


QUERIES.update({
    "c01_status_map": c01_status_map, "c02_matches": c02_matches, "c03_goals": c03_goals,
    "c04_cards": c04_cards, "c05_substitutions": c05_substitutions,
    "c07_normalize_match": c07_normalize_match,
    "a06_upsert_latest": a06_upsert_latest, "a08_finished": a08_finished, "a09_scheduled": a09_scheduled,
    "a10_live": a10_live, "a11_by_status": a11_by_status,
    "b11_snapshot_changes": b11_snapshot_changes, "b12_event_fanout": b12_event_fanout,
    "b13_new_events": b13_new_events,
    "i01_team_rows": i01_team_rows, "i03_recency_weights": i03_recency_weights,
    "i04_team_features": i04_team_features, "i11_merge_advanced": i11_merge_advanced,
    "i12_player_features": i12_player_features, "i17_top_players": i17_top_players,
    "i18_standings": i18_standings, "i19_top_scorers": i19_top_scorers,
})


# ---- text cleaning and filtering (B01, B04, D02-D19) -------------------------
from fansignal.functions import text as tx  # noqa: E402
from fansignal.functions.scoring import tokens as _tokens  # noqa: E402


def _texts(spark, sf_dir):
    return fx.texts_v(spark, sf_dir)


def _text_step(fn):
    def q(spark, sf_dir):
        return _texts(spark, sf_dir).select("doc_id", fn(F.col("text")).alias("text_out"))
    return q


def d06_strip_accents(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", tx.strip_accents(F.col("text")).alias("text_out"))


def d08_slang(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", tx.rewrite_slang(tx.strip_accents(F.col("text"))).alias("text_out"))


def d10_word_filter(spark, sf_dir):
    t = _texts(spark, sf_dir)
    return t.filter(tx.word_count(F.col("text")) >= 4).select("doc_id", tx.word_count(F.col("text")).alias("words"))


def d11_letter_ratio(spark, sf_dir):
    t = _texts(spark, sf_dir)
    return _round(t.filter(tx.letter_ratio(F.col("text")) >= 0.4)
                  .select("doc_id", tx.letter_ratio(F.col("text")).alias("letter_ratio")), {"letter_ratio": 9})


def d12_clean_text(spark, sf_dir):
    return tx.clean_rows(_texts(spark, sf_dir).select("doc_id", "text"), out_col="text_clean").select("doc_id", "text_clean")


def d13_bot_author(spark, sf_dir):
    p = fx.posts_v(spark, sf_dir)
    return p.filter(tx.is_bot_author(F.col("author"))).select("post_id", "author")


def d14_low_score(spark, sf_dir):
    p = fx.posts_v(spark, sf_dir)
    return p.filter(tx.is_low_score(F.col("score"))).select("post_id", "score")


def d15_repeated_chars(spark, sf_dir):
    t = _texts(spark, sf_dir)
    return t.filter(tx.is_repeated_char_spam(F.col("text"))).select("doc_id")


def d16_spam(spark, sf_dir):
    t = _texts(spark, sf_dir).withColumn("score", (F.col("doc_id") % 40 - 25).cast("int"))
    return t.filter(tx.is_spam(F.col("author"), F.col("score"), F.col("text"))).select("doc_id")


def d17_language(spark, sf_dir):
    t = tx.clean_rows(_texts(spark, sf_dir).select("doc_id", "lang", "text"), out_col="c")
    return t.groupBy("lang", tx.detect_language(F.col("c")).alias("detected")).agg(F.count(F.lit(1)).alias("docs"))


def d18_tokens(spark, sf_dir):
    t = _texts(spark, sf_dir)
    tok = _tokens(F.col("text"))
    return t.select("doc_id", F.size(tok).alias("n_tokens"), F.array_join(tok, " ").alias("tokens"))


def d19_truncate(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", tx.truncate(F.col("text"), 1000).alias("text_out"))


def b01_relevance(spark, sf_dir):
    return _texts(spark, sf_dir).filter(tx.is_relevant(F.col("text"))).select("doc_id")


def b04_track_rule(spark, sf_dir):
    return _texts(spark, sf_dir).filter(tx.matches_track_rule(F.col("text"), F.col("lang"))).select("doc_id")


QUERIES.update({
    "d02_html_entities": _text_step(tx.strip_html_entities), "d03_urls": _text_step(tx.remove_urls),
    "d04_mentions": _text_step(tx.remove_mentions), "d05_hashtags": _text_step(tx.unwrap_hashtags),
    "d06_strip_accents": d06_strip_accents, "d07_emoji": _text_step(tx.remove_emoji),
    "d08_slang": d08_slang, "d09_whitespace": _text_step(tx.collapse_whitespace),
    "d10_word_filter": d10_word_filter, "d11_letter_ratio": d11_letter_ratio,
    "d12_clean_text": d12_clean_text, "d13_bot_author": d13_bot_author, "d14_low_score": d14_low_score,
    "d15_repeated_chars": d15_repeated_chars, "d16_spam": d16_spam, "d17_language": d17_language,
    "d18_tokens": d18_tokens, "d19_truncate": d19_truncate,
    "b01_relevance": b01_relevance, "b04_track_rule": b04_track_rule,
})


# ---- de-duplication (E01-E07) -------------------------------------------------
from fansignal.operators import dedup as dd  # noqa: E402
from fansignal.sources.tables import table as _table  # noqa: E402


def _docs(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("doc_id").alias("ts"), "text")


def e01_shingles(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.size(dd.shingles(F.col("text"))).alias("n_shingles"))


def e02_jaccard_adjacent(spark, sf_dir):
    """Jaccard of each document with the next doc_id (an equi join on doc_id + 1)."""
    d = _docs(spark, sf_dir).select("doc_id", dd.shingles(F.col("text")).alias("s"))
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("s2"))
    return _round(d.join(nxt, "doc_id").select("doc_id", dd.jaccard(F.col("s"), F.col("s2")).alias("jaccard")))


def e03_near_dup_pairs(spark, sf_dir):
    return _round(dd.near_duplicate_pairs(_docs(spark, sf_dir)))


def e05_keep_first(spark, sf_dir):
    return dd.keep_first(_docs(spark, sf_dir)).select("doc_id")


def e06_rolling_dedup(spark, sf_dir):
    t = fx.texts_v(spark, sf_dir)
    return dd.rolling_dedup(t, ["source"], ["ts", "doc_id"]).select("doc_id")


def e07_exact_dups(spark, sf_dir):
    g = dd.exact_duplicate_groups(_docs(spark, sf_dir))
    return g.filter(F.col("id") != F.col("rep_id")).select(F.col("id").alias("doc_id"), "rep_id")


QUERIES.update({
    "e01_shingles": e01_shingles, "e02_jaccard_adjacent": e02_jaccard_adjacent,
    "e03_near_dup_pairs": e03_near_dup_pairs, "e05_keep_first": e05_keep_first,
    "e06_rolling_dedup": e06_rolling_dedup, "e07_exact_dups": e07_exact_dups,
})


# ---- enrichment (F), remaining sentiment panels (G), team mentions (H) --------
from fansignal.functions import scoring as scf  # noqa: E402
from fansignal.operators import enrich as en  # noqa: E402


def _team_dim(spark, sf_dir):
    m = fx.matches_v(spark, sf_dir)
    return m.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct()


def _text_posts(spark, sf_dir):
    """texts_v as posts scored by the lexicon scorer."""
    t = fx.texts_v(spark, sf_dir).withColumnRenamed("doc_id", "post_id").withColumnRenamed("ts", "timestamp")
    return en.score_posts(t)


def f01_decay_weight(spark, sf_dir):
    p = fx.posts_v(spark, sf_dir)
    return _round(p.select("post_id", scf.time_decay_weight(F.col("timestamp"), fx.as_of_col()).alias("weight")),
                  {"weight": 9})


def f02_engagement_weight(spark, sf_dir):
    p = fx.posts_v(spark, sf_dir)
    return _round(p.select("post_id", scf.engagement_weight(F.col("score"), F.col("like_count")).alias("weight")))


def f04_assign_matches(spark, sf_dir):
    posts = _text_posts(spark, sf_dir)
    pairs = sent.post_team_pairs(posts, _team_dim(spark, sf_dir))
    m = fx.matches_v(spark, sf_dir)
    out = en.assign_matches(posts, pairs, m)
    return out.select("post_id", "match_id", "match_phase")


def f06_lexicon_score(spark, sf_dir):
    return _round(_text_posts(spark, sf_dir).select("post_id", "sentiment_label", "sentiment_score"))


def f11_entity_filter(spark, sf_dir):
    p = fx.posts_v(spark, sf_dir)
    e = F.concat(F.col("entities"), F.array(
        F.struct(F.lit("x").alias("name"), F.lit("ORG").alias("type"), F.lit(0.5).alias("score")),
        F.struct(F.lower(F.col("entities")[0]["name"]).alias("name"), F.lit("ORG").alias("type"),
                 F.lit(0.123456).alias("score")),
        F.struct(F.lit("Paris").alias("name"), F.lit("LOC").alias("type"), F.lit(0.9).alias("score"))))
    f = en.filter_entities(e)
    return p.select("post_id", F.size(f).alias("n_entities"),
                    F.array_join(F.transform(f, lambda x: F.concat_ws(":", x["name"], x["type"],
                                                                       x["score"].cast("string"))), "|").alias("entities"))


def f12_gazetteer(spark, sf_dir):
    posts = _text_posts(spark, sf_dir)
    names = _team_dim(spark, sf_dir).select(F.col("team").alias("name"), F.lit("ORG").alias("type"))
    g = en.gazetteer_entities(posts, names)
    return g.select("post_id", F.array_join(F.transform("entities", lambda e: e["name"]), ",").alias("entities"))


def f14_aggregate_sentiment(spark, sf_dir):
    p = fx.posts_v(spark, sf_dir)
    return _round(en.aggregate_sentiment(p, ["source"], fx.as_of_col()))


def f15_phase_breakdown(spark, sf_dir):
    posts = _text_posts(spark, sf_dir)
    pairs = sent.post_team_pairs(posts, _team_dim(spark, sf_dir))
    a = en.assign_matches(posts, pairs, fx.matches_v(spark, sf_dir))
    b = en.phase_breakdown(a, ["source"])
    return _round(b.select("source", F.explode("phase_breakdown").alias("phase", "v"))
                  .select("source", "phase", F.col("v.avg").alias("avg"), F.col("v.count").alias("count")))


def f17_thread_sample(spark, sf_dir):
    posts = _text_posts(spark, sf_dir)
    pairs = sent.post_team_pairs(posts, _team_dim(spark, sf_dir))
    a = en.assign_matches(posts, pairs, fx.matches_v(spark, sf_dir))
    s = en.match_thread_sample(a, 30)
    return s.select("match_id", "sample", F.length("sample").alias("sample_chars"), "posts")


def g02_histogram(spark, sf_dir):
    p = sent.time_range(fx.posts_v(spark, sf_dir), fx.as_of_col(), ALL_HOURS)
    return _round(sent.bucket_stats(p, "15m"))


def g03_gap_fill(spark, sf_dir):
    p = sent.time_range(fx.posts_v(spark, sf_dir), fx.as_of_col(), ALL_HOURS)
    return _round(sent.fill_gaps(sent.bucket_stats(p, "15m"), "15m"))


def g05_top_entities(spark, sf_dir):
    p = sent.time_range(fx.posts_v(spark, sf_dir), fx.as_of_col(), ALL_HOURS)
    return sent.top_entities(p, "1h", 5)


def g07_timeline(spark, sf_dir):
    return _round(sent.timeline(fx.posts_v(spark, sf_dir), fx.as_of_col(), ALL_HOURS, "1h"))


def g10_events_near(spark, sf_dir):
    spikes = sent.detect_spikes(fx.posts_v(spark, sf_dir), fx.as_of_col(), interval="1h", hours_back=ALL_HOURS)
    ev = sent.events_near(spikes, fx.matches_v(spark, sf_dir), 30)
    return ev.withColumn("marker", sent.event_marker(F.col("type")))


def g12_label_distribution(spark, sf_dir):
    return sent.label_distribution(fx.posts_v(spark, sf_dir), 3)


def g13_post_volume(spark, sf_dir):
    return sent.post_volume(fx.posts_v(spark, sf_dir), "15m")


def g14_sentiment_by_source(spark, sf_dir):
    return _round(sent.sentiment_by_source(fx.posts_v(spark, sf_dir), "1h", 5))


def g15_sentiment_over_time(spark, sf_dir):
    return _round(sent.sentiment_over_time(fx.posts_v(spark, sf_dir), "15m"))


def h01_mentions_team(spark, sf_dir):
    t = fx.texts_v(spark, sf_dir)
    return t.filter(sent.mentions_team(F.col("text"), "TEAM_3")).select("doc_id")


def h02_post_team_pairs(spark, sf_dir):
    return sent.post_team_pairs(_text_posts(spark, sf_dir), _team_dim(spark, sf_dir))


def _team_sentiment(spark, sf_dir):
    return sent.team_sentiment(_text_posts(spark, sf_dir), _team_dim(spark, sf_dir), fx.sentiment_as_of(), fx.SENTIMENT_HOURS)


def g01_time_range(spark, sf_dir):
    """Posts of the default 48 hours before the middle of the month."""
    return sent.time_range(fx.posts_v(spark, sf_dir), F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"), 48).select("post_id", "timestamp")


def h03_team_sentiment(spark, sf_dir):
    """Sentiment of every team over all posts."""
    return _round(sent.team_sentiment(_text_posts(spark, sf_dir), _team_dim(spark, sf_dir), fx.as_of_col(), None))


QUERIES.update({
    "f01_decay_weight": f01_decay_weight, "f02_engagement_weight": f02_engagement_weight,
    "f04_assign_matches": f04_assign_matches, "f06_lexicon_score": f06_lexicon_score,
    "f11_entity_filter": f11_entity_filter, "f12_gazetteer": f12_gazetteer,
    "f14_aggregate_sentiment": f14_aggregate_sentiment, "f15_phase_breakdown": f15_phase_breakdown,
    "f17_thread_sample": f17_thread_sample,
    "g02_histogram": g02_histogram, "g03_gap_fill": g03_gap_fill, "g05_top_entities": g05_top_entities,
    "g07_timeline": g07_timeline, "g10_events_near": g10_events_near,
    "g12_label_distribution": g12_label_distribution, "g13_post_volume": g13_post_volume,
    "g14_sentiment_by_source": g14_sentiment_by_source, "g15_sentiment_over_time": g15_sentiment_over_time,
    "h01_mentions_team": h01_mentions_team, "h02_post_team_pairs": h02_post_team_pairs,
    "h03_team_sentiment": h03_team_sentiment, "g01_time_range": g01_time_range,
})


# ---- outcome model (L01-L12) -----------------------------------------------------
from fansignal.operators import model as mdl  # noqa: E402
from fansignal.operators import registry as reg  # noqa: E402
from fansignal.operators import stats as st  # noqa: E402


MATCH_TABLES = ["orders", "customer", "lineitem"]
RESULTS_EPOCH = [0]        # part of the folder's name; the benchmark raises it to rebuild


def _shared(spark, sf_dir, name, build, tables):
    """A result shared by all queries of this application (M12), rebuilt when it is old or its
    tables have changed."""
    import hashlib

    from fansignal.session import shared_dir
    from fansignal.sources.shared import SharedResults
    root = f"{shared_dir(spark)}/results/{spark.sparkContext.applicationId}-{RESULTS_EPOCH[0]}"
    where = sf_dir.rstrip("/")
    return SharedResults(spark, root).get(f"{name}-{hashlib.sha256(where.encode()).hexdigest()[:12]}", build, [f"{where}/{t}.parquet" for t in tables])


def _team_table(spark, sf_dir):
    """One row per team: form features, advanced statistics of the fixtures (K05) and then of the
    other provider, and the sentiment of the posts before the matches."""
    def build():
        tf = feat.team_features(_finished(spark, sf_dir))
        tf = feat.merge_advanced_stats(tf, st.team_advanced_stats(st.fixture_stats_wide(fx.fixture_stats_v(spark, sf_dir))))
        tf = feat.merge_advanced_stats(tf, fx.adv_stats_v(spark, sf_dir))
        return tf.join(_team_sentiment(spark, sf_dir), "team", "left")
    return _shared(spark, sf_dir, "teams", build, [*MATCH_TABLES, "nation", "documents"])


SENTIMENT_COLUMNS = ["avg_sentiment", "post_count", "positive_ratio", "negative_ratio"]


def _merged_tf(spark, sf_dir):
    return _team_table(spark, sf_dir).drop(*SENTIMENT_COLUMNS)


def _stored_sentiment(spark, sf_dir):
    return _shared(spark, sf_dir, "sentiment", lambda: _team_sentiment(spark, sf_dir), [*MATCH_TABLES, "documents"])


def _players(spark, sf_dir):
    return _shared(spark, sf_dir, "players", lambda: feat.player_features(_finished(spark, sf_dir)), MATCH_TABLES)


def _profile(spark, sf_dir):
    return mdl.team_profile(_team_table(spark, sf_dir))


def l01_feature_rows(spark, sf_dir):
    return _round(mdl.feature_rows(_finished(spark, sf_dir), _profile(spark, sf_dir), keep=["match_id"]))


def l02_labels(spark, sf_dir):
    m = _finished(spark, sf_dir)
    return m.groupBy(mdl.encode_outcome(F.col("winner")).alias("label")).agg(F.count(F.lit(1)).alias("matches"))


def l04_scaling(spark, sf_dir):
    fr = mdl.training_frame(_finished(spark, sf_dir), _profile(spark, sf_dir))
    st = mdl.scaling_stats(fr)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"mu_{c}").alias("mu"),
                                         F.col(f"sd_{c}").alias("sd")) for c in mdl.FEATURE_NAMES]))
    return _round(st.select(pairs.alias("x")).select("x.*"))


def _fitted(spark, sf_dir):
    """The fitted model and the profile it was fitted on: whoever scores with it reads the same table,
    which a fit longer than the limit of shared results would make old."""
    profile = _profile(spark, sf_dir)
    model, _ = mdl.fit_logistic(mdl.training_frame(_finished(spark, sf_dir), profile))
    return model, profile


def l05_logistic_predictions(spark, sf_dir):
    model, profile = _fitted(spark, sf_dir)
    rows = mdl.feature_rows(msrc.scheduled_matches(fx.matches_v(spark, sf_dir)), profile,
                            keep=["match_id", "home_team", "away_team"])
    return mdl.predict(model, rows, ["match_id", "home_team", "away_team"])


def l06_boosted_predictions(spark, sf_dir):
    profile = _profile(spark, sf_dir)
    models = mdl.fit_boosted(mdl.training_frame(_finished(spark, sf_dir), profile))
    rows = mdl.feature_rows(msrc.scheduled_matches(fx.matches_v(spark, sf_dir)), profile, keep=["match_id"])
    return mdl.score_boosted(models, rows, ["match_id"])


def l09_leaderboard(spark, sf_dir):
    return _round(mdl.leaderboard(mdl.reference_scorer(), _profile(spark, sf_dir), block_size=8))


def l09_leaderboard_fitted(spark, sf_dir):
    model, profile = _fitted(spark, sf_dir)
    return _round(mdl.leaderboard(model, profile))


def l07_predict_closed_form(spark, sf_dir):
    rows = mdl.feature_rows(msrc.scheduled_matches(fx.matches_v(spark, sf_dir)), _profile(spark, sf_dir),
                            keep=["match_id"])
    return mdl.predict(mdl.reference_scorer(), rows, ["match_id"], source="closed_form")


def l10_to_show(spark, sf_dir):
    m = fx.matches_v(spark, sf_dir)
    return mdl.predictions_to_show(msrc.scheduled_matches(m), msrc.finished_matches(m)).select("match_id", "utc_date")


def l11_prediction_card(spark, sf_dir):
    m = fx.matches_v(spark, sf_dir)
    show = mdl.predictions_to_show(msrc.scheduled_matches(m), msrc.finished_matches(m))
    keep = ["match_id", "utc_date", "home_team", "away_team"]
    teams = _team_table(spark, sf_dir)
    pred = mdl.predict(mdl.reference_scorer(), mdl.feature_rows(show, mdl.team_profile(teams), keep=keep), keep, source="closed_form")
    cards = mdl.prediction_cards(pred, teams, feat.top_players_per_team(_players(spark, sf_dir), 3))
    line = lambda p: F.concat_ws(" ", p["player"], p["goals"].cast("string"), p["assists"].cast("string"))
    return _round(cards.withColumns({f"{s}_players": F.array_join(F.transform(f"{s}_players", line), ", ") for s in ("home", "away")}))


def l12_approval(spark, sf_dir):
    """The logistic model fitted on four fifths of the matches and judged on the others."""
    frame = mdl.training_frame(_finished(spark, sf_dir), _profile(spark, sf_dir))
    train, test = reg.held_out(frame, "match_id")
    model, _ = mdl.fit_logistic(train)
    return reg.judged(reg.evaluate(train, test, model.proba_columns()))


def a14_training_csv(spark, sf_dir):
    """The training set written as headerless CSV and read back."""
    import uuid

    from fansignal.session import shared_dir
    from fansignal.sources.store import export_training_csv, read_training_csv
    path = f"{shared_dir(spark)}/training/{uuid.uuid4().hex}"
    export_training_csv(mdl.training_frame(_finished(spark, sf_dir), _profile(spark, sf_dir)), path, mdl.FEATURE_NAMES)
    return _round(read_training_csv(spark, path, mdl.FEATURE_NAMES))


QUERIES.update({
    "l01_feature_rows": l01_feature_rows, "l02_labels": l02_labels, "l04_scaling": l04_scaling,
    "l05_logistic_predictions": l05_logistic_predictions, "l06_boosted_predictions": l06_boosted_predictions,
    "l07_predict_closed_form": l07_predict_closed_form, "l09_leaderboard": l09_leaderboard,
    "l09_leaderboard_fitted": l09_leaderboard_fitted, "l10_to_show": l10_to_show, "l12_approval": l12_approval,
    "l11_prediction_card": l11_prediction_card, "a14_training_csv": a14_training_csv,
})


# ---- J, K, M ---------------------------------------------------------------------------


def j01_normalize_features(spark, sf_dir):
    n = feat.normalize_features(_merged_tf(spark, sf_dir))
    return _round(n.select("team", *[f"{c}_z" for c in feat.ZSCORE_FEATURES], "goals_per_match",
                           "conceded_per_match", "xg_per_match", "xga_per_match", "shots_per_match"))


def j03_engineer_match_features(spark, sf_dir):
    m = fx.matches_v(spark, sf_dir).filter(F.col("status").isin("SCHEDULED", "TIMED"))
    return _round(feat.engineer_match_features(m, _merged_tf(spark, sf_dir), _stored_sentiment(spark, sf_dir)))


def k01_fixture_stats(spark, sf_dir):
    return _round(st.fixture_stats_wide(fx.fixture_stats_v(spark, sf_dir)))


def k05_team_advanced(spark, sf_dir):
    return _round(st.team_advanced_stats(st.fixture_stats_wide(fx.fixture_stats_v(spark, sf_dir))))


def k06_player_advanced(spark, sf_dir):
    return _round(st.player_advanced_stats(fx.player_stats_v(spark, sf_dir), ["fixture_id", "line"]))


def m01_kpis(spark, sf_dir):
    m = fx.matches_v(spark, sf_dir)
    played = m.agg(F.count_if(F.col("status") == "FINISHED").alias("matches_played"),
                   F.count_if(F.col("status").isin("SCHEDULED", "TIMED")).alias("upcoming"))
    tf = _team_table(spark, sf_dir).agg(F.count(F.lit(1)).alias("teams"))
    pf = _players(spark, sf_dir).agg(F.count(F.lit(1)).alias("players"))
    ts = _stored_sentiment(spark, sf_dir).agg(F.sum("post_count").alias("posts"), F.avg("avg_sentiment").alias("mean_sentiment"))
    # four one-row aggregates side by side (each side is exactly one row)
    return _round(played.crossJoin(tf).crossJoin(pf).crossJoin(ts))


def m02_leaderboard_table(spark, sf_dir):
    teams = _team_table(spark, sf_dir)      # read once: the second time it could be old
    lb = mdl.leaderboard(mdl.reference_scorer(), mdl.team_profile(teams), block_size=8)
    t = teams.select("team", "form_score", "goal_difference", "total_points", "matches_played",
                     F.coalesce("avg_sentiment", F.lit(0.5)).alias("avg_sentiment"))
    return _round(lb.join(t, "team", "left").orderBy("rank"), {"avg_sentiment": 3})


def m03_team_sentiment_table(spark, sf_dir):
    ts = _stored_sentiment(spark, sf_dir)
    return _round(ts.select("team", (F.col("avg_sentiment") * 100).alias("sentiment_pct"), "post_count",
                            (F.col("positive_ratio") * 100).alias("positive_pct"),
                            (F.col("negative_ratio") * 100).alias("negative_pct")).orderBy(F.col("sentiment_pct").desc(), "team"))


def m04_player_table(spark, sf_dir, team: str | None = None, min_matches: int = 1, sort_by: str = "goal_contributions_per_match"):
    """Players of all teams or one, with at least ``min_matches``, best first by any column."""
    pf = _players(spark, sf_dir).withColumn("contributions", F.col("goals") + F.col("assists"))
    pf = pf.filter(F.col("matches") >= min_matches)
    if team is not None:
        pf = pf.filter(F.col("team") == team)
    return _round(pf.orderBy(F.col(sort_by).desc(), "player"))


def m04_team_players(spark, sf_dir):
    return m04_player_table(spark, sf_dir, team="TEAM_3", min_matches=3, sort_by="goals")


def m05_top20(spark, sf_dir):
    pf = feat.player_features(_finished(spark, sf_dir))
    return _round(pf.orderBy(F.col("goal_contributions_per_match").desc(), "player").limit(20)
                  .select("player", "team", "goals", "assists", "goal_contributions_per_match",
                          "yellow_cards", "red_cards"))


def m06_scoring_depth(spark, sf_dir):
    pf = feat.player_features(_finished(spark, sf_dir))
    return pf.groupBy("team").agg(F.sum("goals").alias("goals"), F.sum("assists").alias("assists"))


def m07_team_list(spark, sf_dir):
    t = _team_dim(spark, sf_dir)
    return t.unionByName(spark.range(1).select(F.lit("All").alias("team"))).distinct()


# Measures of the advanced team table, their factor and decimals.
ADVANCED_TABLE = {"xg": (1, 2), "xga": (1, 2), "xg_difference": (1, 2), "avg_possession": (100, 1), "shot_accuracy": (100, 1),
                  "avg_pass_accuracy": (100, 1), "avg_shots_on_target": (1, 1), "avg_corners": (1, 1), "ppda": (1, 2),
                  "progressive_passes": (1, 1), "progressive_carries": (1, 1), "pressures": (1, 1)}


def m08_advanced_team_table(spark, sf_dir):
    measures = [F.round((F.col(c) * f).cast("decimal(38,12)"), p).cast("double").alias(c) for c, (f, p) in ADVANCED_TABLE.items()]
    return _merged_tf(spark, sf_dir).select("team", *measures).orderBy(F.col("xg_difference").desc(), "team")


def m09_data_present(spark, sf_dir):
    return _merged_tf(spark, sf_dir).agg((F.sum("xg") > 0).alias("has_advanced"))


def m10_ppda_ranking(spark, sf_dir):
    return _round(_merged_tf(spark, sf_dir).filter(F.col("ppda") > 0).select("team", "ppda").orderBy("ppda"))


def m11_advanced_player_merge(spark, sf_dir, team: str | None = None, sort_by: str = "xg"):
    """Base players, per-90 statistics and the other provider's table by name; a player without a
    team in the base table is dropped. For all teams or one, sorted by any measure."""
    base = _players(spark, sf_dir).select(F.col("player").alias("name"), "team", "goals", "assists", "matches", "goal_contributions_per_match")
    per90 = st.player_advanced_stats(fx.player_stats_v(spark, sf_dir), ["fixture_id", "line"]).select("name", "key_passes_per90", "defensive_actions_per90")
    d = base.join(per90, "name", "full").join(fx.external_players_v(spark, sf_dir), "name", "full")
    zero = lambda c, p: F.round(F.coalesce(c, F.lit(0.0)).cast("decimal(38,12)"), p).cast("double")
    out = d.filter(F.col("team").isNotNull() & (F.col("team") != "")).select(
        "name", "team", F.coalesce("goals", F.lit(0)).alias("goals"), F.coalesce("assists", F.lit(0)).alias("assists"),
        *[zero(F.col(c), 2).alias(c) for c in ("xg", "xa", "npxg")],
        zero(F.coalesce("key_passes_per90", "key_passes"), 2).alias("key_passes_per90"),
        *[zero(F.col(c), 2).alias(c) for c in ("progressive_passes", "progressive_carries")],
        *[zero(F.col(c), 1).alias(c) for c in ("pressures", "aerial_won_pct")],
        zero(F.col("defensive_actions_per90"), 2).alias("defensive_actions_per90"),
        zero(F.col("goal_contributions_per_match"), 2).alias("goal_contributions_per_match"))
    if team is not None:
        out = out.filter(F.col("team") == team)
    return out.orderBy(F.col(sort_by).desc(), "name")


def m11_team_players(spark, sf_dir):
    return m11_advanced_player_merge(spark, sf_dir, team="TEAM_3", sort_by="defensive_actions_per90")


QUERIES.update({
    "j01_normalize_features": j01_normalize_features, "j03_engineer_match_features": j03_engineer_match_features,
    "k01_fixture_stats": k01_fixture_stats, "k05_team_advanced": k05_team_advanced,
    "k06_player_advanced": k06_player_advanced,
    "m01_kpis": m01_kpis, "m02_leaderboard_table": m02_leaderboard_table,
    "m03_team_sentiment_table": m03_team_sentiment_table, "m04_player_table": m04_player_table,
    "m05_top20": m05_top20, "m06_scoring_depth": m06_scoring_depth, "m07_team_list": m07_team_list,
    "m08_advanced_team_table": m08_advanced_team_table, "m09_data_present": m09_data_present,
    "m10_ppda_ranking": m10_ppda_ranking, "m11_advanced_player_merge": m11_advanced_player_merge,
    "m04_team_players": m04_team_players, "m11_team_players": m11_team_players,
})


def f05_preprocess(spark, sf_dir):
    t = fx.texts_v(spark, sf_dir).withColumnRenamed("doc_id", "post_id").withColumnRenamed("ts", "timestamp")
    p = en.preprocess(t, fx.as_of_col())
    return _round(p.select("post_id", "text", "time_decay_weight", "engagement_weight"))


def _snapshots(spark, sf_dir):
    tf = _merged_tf(spark, sf_dir)
    ts = _stored_sentiment(spark, sf_dir)
    t0 = F.unix_seconds(fx.as_of_col().cast("timestamp"))
    early = feat.feature_snapshot(tf, ts, t0 - 86400).withColumn("form_score", F.lit(0.0))
    return early.unionByName(feat.feature_snapshot(tf, ts, t0))


def a15_feature_snapshot(spark, sf_dir):
    return _round(_snapshots(spark, sf_dir))


def a16_latest_snapshot(spark, sf_dir):
    return _round(feat.latest_snapshot(_snapshots(spark, sf_dir)))


QUERIES.update({"f05_preprocess": f05_preprocess, "a15_feature_snapshot": a15_feature_snapshot,
                "a16_latest_snapshot": a16_latest_snapshot})


# ---- provider payloads, search and polls (B02, B03, B05-B10) ----------------------------
from fansignal.plans import ingest  # noqa: E402

QUERIES.update(ingest.QUERIES)


# ---- A07, A12, A14, A16, D17 ---------------------------------------------------------------
from fansignal.functions import language as lg  # noqa: E402
from fansignal.operators import asof  # noqa: E402


def a16_as_of(spark, sf_dir):
    """Record of both teams of every match as it stood at kick-off."""
    rows = feat.team_match_rows(_finished(spark, sf_dir))
    history = asof.daily_history(rows)
    m = fx.matches_v(spark, sf_dir)
    sides = m.select("match_id", "utc_date", F.explode(F.array(
        F.struct(F.lit("home").alias("side"), F.col("home_team").alias("team")),
        F.struct(F.lit("away").alias("side"), F.col("away_team").alias("team")))).alias("s"))
    return asof.as_of(sides.select("match_id", "utc_date", "s.side", "s.team"), history, "team", "utc_date", "valid_from")


def d17_vote(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", lg.detect_by_vote(F.col("text")).alias("detected"))


def a07_full_sync(spark, sf_dir):
    """Fixtures of all statuses; events joined for finished ones only (the default)."""
    m = msrc.normalize_fixtures(fx.fixtures_raw_v(spark, sf_dir), fx.fixture_events_v(spark, sf_dir))
    return m.select("match_id", "status", F.size("goals").alias("n_goals"), F.size("cards").alias("n_cards"), F.size("substitutions").alias("n_subs"))


def a12_fixture_events(spark, sf_dir):
    """Events of the fixtures that are live now, looked up by their ids."""
    ids = msrc.live_fixtures(fx.fixtures_raw_v(spark, sf_dir)).select(F.col("fixture.id").alias("fixture_id"))
    e = msrc.events_of(fx.fixture_events_v(spark, sf_dir), ids)
    return e.select("fixture_id", "pos", F.col("team.name").alias("team"), F.col("player.name").alias("player"),
                    F.col("time.elapsed").alias("minute"), "type", "detail")


QUERIES.update({"a07_full_sync": a07_full_sync, "a12_fixture_events": a12_fixture_events, "a16_as_of": a16_as_of, "d17_vote": d17_vote})
