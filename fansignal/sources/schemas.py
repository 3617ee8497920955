"""Declared schemas (no inference on the hot path)."""
from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()

POSTS_RAW = T.StructType([
    T.StructField("source", S), T.StructField("source_id", S), T.StructField("id", S),
    T.StructField("text", S), T.StructField("author", S), T.StructField("subreddit", S),
    T.StructField("video_title", S), T.StructField("video_id", S), T.StructField("published_at", S),
    T.StructField("like_count", I), T.StructField("score", I), T.StructField("timestamp", S),
])

ENTITY = T.StructType([T.StructField("name", S), T.StructField("type", S), T.StructField("score", D)])

POSTS = T.StructType([
    T.StructField("text", S), T.StructField("source", S), T.StructField("source_id", S),
    T.StructField("author", S), T.StructField("subreddit", S), T.StructField("video_title", S),
    T.StructField("sentiment_label", S), T.StructField("sentiment_score", D),
    T.StructField("entities", T.ArrayType(ENTITY)), T.StructField("match_phase", S),
    T.StructField("time_decay_weight", D), T.StructField("engagement_weight", D),
    T.StructField("timestamp", TS), T.StructField("processed_at", TS),
])

GOAL = T.StructType([T.StructField("minute", I), T.StructField("team", S), T.StructField("scorer", S),
                     T.StructField("assist", S), T.StructField("type", S)])
CARD = T.StructType([T.StructField("minute", I), T.StructField("team", S), T.StructField("player", S),
                     T.StructField("card", S)])
SUB = T.StructType([T.StructField("minute", I), T.StructField("team", S), T.StructField("player_out", S),
                    T.StructField("player_in", S)])

MATCHES = T.StructType([
    T.StructField("match_id", L), T.StructField("status", S), T.StructField("stage", S),
    T.StructField("matchday", I), T.StructField("utc_date", T.TimestampNTZType()),
    T.StructField("home_team", S), T.StructField("away_team", S),
    T.StructField("home_score_ft", I), T.StructField("away_score_ft", I),
    T.StructField("home_score_ht", I), T.StructField("away_score_ht", I),
    T.StructField("winner", S), T.StructField("goals", T.ArrayType(GOAL)),
    T.StructField("cards", T.ArrayType(CARD)), T.StructField("substitutions", T.ArrayType(SUB)),
    T.StructField("last_updated", TS),
])

MATCH_EVENT = T.StructType([
    T.StructField("event_type", S), T.StructField("match_id", L), T.StructField("home_team", S),
    T.StructField("away_team", S), T.StructField("utc_date", T.TimestampNTZType()),
    T.StructField("timestamp", TS), T.StructField("minute", I), T.StructField("team", S),
    T.StructField("scorer", S), T.StructField("assist", S), T.StructField("type", S),
    T.StructField("player", S), T.StructField("card", S),
])
