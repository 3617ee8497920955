"""Payload projections, video search and polls on hand-typed rows."""
import json

from pyspark.sql import functions as F

from fansignal.sources import providers as pv


def payloads(spark, *objects):
    rows = [(i, o if o is None or isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)]
    return spark.createDataFrame(rows, "n int, payload string")


def test_submissions(spark):
    df = payloads(
        spark,
        {"id": "a", "title": " World Cup", "selftext": "body\n", "author": {"name": "ann"}, "subreddit": {"display_name": "soccer"}, "created_utc": 1780272000},
        {"id": "b", "title": "fifa", "author": None, "subreddit": {"display_name": "x"}, "created_utc": 1780272000.5},     # no body, deleted author
        {"id": "c", "title": "nothing here", "selftext": "at all"},                                                       # not relevant
        {"id": 7, "title": "worldcup " + "y" * 3000, "author": "not an object", "subreddit": None, "created_utc": "soon"},  # other types
        {"title": "world cup without id"}, "{cut", "[1, 2]", None)
    got = {r.source_id: r for r in pv.submission_posts(df).collect()}
    assert sorted(got) == ["7", "a", "b"]
    assert (got["a"].text, got["a"].author, got["a"].subreddit, str(got["a"].timestamp)) == ("World Cup body", "ann", "soccer", "2026-06-01 00:00:00")
    assert (got["b"].text, got["b"].author) == ("fifa", "[deleted]")
    assert (len(got["7"].text), got["7"].author, got["7"].subreddit, got["7"].timestamp) == (2000, "[deleted]", None, None)
    aside = {r.n: r.reason for r in pv.quarantined(df).collect()}
    assert aside == {4: "no id", 5: "malformed", 6: "no id", 7: "malformed"}


def test_comments_drop_short_ones(spark):
    df = payloads(spark, {"id": "a", "body": "fifa 26"}, {"id": "b", "body": "  fifa 2026  "}, {"id": "c", "body": " fifa 20267 "}, {"id": "d"})
    assert [(r.source_id, r.text) for r in pv.comment_posts(df).collect()] == [("c", "fifa 20267")]


def test_tweets(spark):
    now = F.lit("2026-07-01 00:00:00").cast("timestamp_ntz")
    df = payloads(spark, {"data": {"id": "1", "text": "t" * 2001, "author_id": 5, "created_at": "2026-06-11T20:00:00Z"}},
                  {"data": {"id": "2"}}, {"data": {"id": "3", "text": None, "created_at": "never"}}, {"id": "4"})
    got = {r.source_id: (len(r.text), r.author, str(r.timestamp)) for r in pv.tweet_posts(df, now).collect()}
    assert got == {"1": (2000, "5", "2026-06-11 20:00:00"), "2": (0, "unknown", "2026-07-01 00:00:00"), "3": (0, "unknown", "2026-07-01 00:00:00")}


def test_threads(spark):
    item = lambda i, **s: {"id": i, "snippet": {"topLevelComment": {"snippet": s}}}
    df = payloads(spark, {"items": [item("a", textDisplay="hi", authorDisplayName="ann", likeCount=3, publishedAt="2026"), item("b", likeCount="12"),
                                    item("c", likeCount="many", textDisplay=None), {"id": "d"}, item(None, textDisplay="no id")]},
                  {"items": []}, {"nextPageToken": "x"}, "{").withColumn("video_id", F.lit("v"))
    got = {r.comment_id: (r.text, r.author, r.like_count, r.published_at) for r in pv.thread_comments(df).collect()}
    assert got == {"a": ("hi", "ann", 3, "2026"), "b": ("", "", 12, ""), "c": ("", "", 0, "")}
    bad = sorted((r.n, r.bad) for r in pv.thread_items(df).filter("bad is not null").collect())
    assert bad == [(0, "no id"), (0, "no id"), (2, "malformed"), (3, "malformed")]


def test_phrases_match_runs_of_words(spark):
    v = spark.createDataFrame([(1, "The World-Cup 2026; highlights! world cup 2026 highlights"), (2, "world cup"), (3, "cup world 2026"), (4, None), (5, "")],
                              "video_id int, title string")
    got = sorted((r.id, r.phrase, r.n) for r in pv.phrase_matches(v, ["World Cup", "world cup 2026 HIGHLIGHTS", "cup", "??", "world cup x"], "title", "video_id").collect())
    assert got == [(1, "World Cup", 2), (1, "cup", 2), (1, "world cup 2026 HIGHLIGHTS", 2), (2, "World Cup", 1), (2, "cup", 1), (3, "cup", 1)]
    assert pv.phrase_matches(v, [], "title", "video_id").count() == 0


def test_search_keeps_the_newest_above_the_floor(spark):
    rows = [(f"v{i:02d}", "a goal" if i != 4 else "none", f"2026-06-{1 + i // 2:02d} 00:00:00") for i in range(12)]
    v = spark.createDataFrame(rows, "video_id string, title string, at string").select("video_id", "title", F.to_timestamp_ntz("at").alias("published_at"))
    got = pv.search_videos(v, ["goal"], F.lit("2026-06-05 00:00:00").cast("timestamp_ntz"), newest=3).orderBy("rank").collect()
    assert [(r.rank, r.video_id) for r in got] == [(1, "v10"), (2, "v11"), (3, "v08")]


def test_polls(spark):
    rows = [(0, 0, "v1", "a", 0), (0, 0, "v1", "a", 1), (1, 600, "v1", "a", 0), (1, 600, "v1", "b", 0), (30, 18000, "v1", "a", 0), (30, 18000, "v2", "c", 0)]
    d = spark.createDataFrame(rows, "cycle long, s long, video_id string, comment_id string, slot int").select(
        "cycle", F.timestamp_seconds("s").cast("timestamp_ntz").alias("poll_ts"), "video_id", "comment_id", "slot")
    counts = {r.cycle: tuple(r)[1:] for r in pv.poll_counts(d, F.expr("INTERVAL 2 HOURS")).collect()}
    assert counts == {0: (2, 1, 1, 0), 1: (2, 1, 1, 0), 30: (2, 1, 1, 1)}       # listed, new, repeats, late repeats
    sight = {(r.cycle, r.video_id): (r.listed, r.new_video) for r in pv.first_sight(d).collect()}
    assert sight == {(0, "v1"): (2, True), (1, "v1"): (2, False), (30, "v1"): (1, False), (30, "v2"): (1, True)}
    first = {r.comment_id: (r.cycle, r.slot) for r in pv.first_seen(d, "comment_id", ["poll_ts", "slot"]).collect()}
    assert first == {"a": (0, 0), "b": (1, 0), "c": (30, 0)}
