"""Provider payloads derived from the generated tables (see FIXTURES.md): JSON text with
missing fields, fields of another type, payloads without id and cut-off JSON, planted by ids.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fansignal.sources.tables import table

START = "2026-06-01 00:00:00"
START_EPOCH = 1780272000
NOW = "2026-07-20 00:00:00"


def now_col() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _from_start(seconds: Column) -> Column:
    return F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def _iso(seconds: Column) -> Column:
    return F.date_format(_from_start(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _cut(payload: Column, when: Column) -> Column:
    """JSON that lost its last character where ``when`` holds."""
    return F.when(when, F.expr("left(p, length(p) - 1)")).otherwise(payload)


def submissions_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions from ``documents``: no id where doc_id % 29 = 0, no author where % 7 = 0, cut off where % 31 = 0."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    title = (F.when(k % 8 == 0, " What a golazo #WorldCup2026").when(k % 8 == 5, "FIFA world cup news")
             .when(k % 8 != 3, "Matchday thread"))
    p = F.to_json(F.struct(
        F.when(k % 29 != 0, F.concat(F.lit("t3_"), k.cast("string"))).alias("id"), title.alias("title"), F.col("text").alias("selftext"),
        F.when(k % 7 != 0, F.struct(F.concat(F.lit("user_"), k.cast("string")).alias("name"))).alias("author"),
        F.struct(F.col("source").alias("display_name")).alias("subreddit"), (START_EPOCH + k * 61).alias("created_utc")))
    return d.select("doc_id", p.alias("p")).select("doc_id", _cut(F.col("p"), k % 31 == 0).alias("payload"))


def reddit_comments_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments from ``conversations``: every fourth mentions the cup, every fourth is short."""
    d, c, t = table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    k = (c + t) % 4
    body = F.when(k == 0, F.concat(F.lit("\n World Cup: "), F.col("text"))).when(k == 1, " fifa 26 ").otherwise(F.col("text"))
    p = F.to_json(F.struct(
        F.concat_ws("_", F.lit("t1"), c.cast("string"), t.cast("string")).alias("id"), body.alias("body"),
        F.when(t % 5 != 0, F.struct(F.concat(F.lit("user_"), c.cast("string")).alias("name"))).alias("author"),
        F.struct(F.col("role").alias("display_name")).alias("subreddit"), (START_EPOCH + c * 600 + t * 30).alias("created_utc")))
    return d.select("conv_id", "turn", p.alias("p")).select("conv_id", "turn", _cut(F.col("p"), (c % 31 == 0) & (t == 1)).alias("payload"))


def tweets_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tweets from ``documents``: no author where doc_id % 3 = 0, no time where % 4 = 0, a bad time where % 4 = 1."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    at = F.when(k % 4 == 1, "yesterday").when(k % 4 != 0, _iso(k * 61))
    p = F.to_json(F.struct(F.struct(
        F.when(k % 29 != 0, k).alias("id"), F.col("text"), F.when(k % 3 != 0, k % 150).alias("author_id"), at.alias("created_at")).alias("data")))
    return d.select("doc_id", p.alias("payload"))


def thread_pages_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment-thread pages of at most 100 turns from ``conversations``; fields missing by turn,
    likes as text every seventh turn, no id where (conv + turn) % 13 = 0, cut off where conv % 31 = 0."""
    d, c, t = table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    likes = F.when(t % 7 == 6, F.concat(F.lit("many "), t.cast("string"))).when(t % 3 != 0, (t * 11).cast("string"))
    snippet = F.struct(
        F.when((c + t) % 11 != 0, F.col("text")).alias("textDisplay"), F.when(t % 5 != 0, F.col("role")).alias("authorDisplayName"),
        likes.alias("likeCount"), F.when(t % 4 != 0, _iso(c * 600 + t * 30)).alias("publishedAt"))
    item = F.struct(F.when((c + t) % 13 != 0, F.concat_ws("_", F.lit("c"), c.cast("string"), t.cast("string"))).alias("id"),
                    F.struct(F.struct(snippet.alias("snippet")).alias("topLevelComment")).alias("snippet"))
    pages = d.groupBy("conv_id", F.floor(t / 100).alias("page")).agg(F.array_sort(F.collect_list(F.struct(t.alias("turn"), item.alias("item")))).alias("items"))
    p = F.to_json(F.struct(F.transform("items", lambda x: x["item"]).alias("items")))
    return pages.select(F.concat(F.lit("v"), c.cast("string")).alias("video_id"), "conv_id", p.alias("p")).select(
        "video_id", _cut(F.col("p"), c % 31 == 0).alias("payload"))


def videos_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos from ``pages``: whole html as description, a planted title for four of nine."""
    d, k = table(spark, sf_dir, "pages"), F.col("page_id")
    title = (F.when(k % 9 == 0, "World Cup 2026 highlights").when(k % 9 == 1, "FIFA World-Cup 2026 match day")
             .when(k % 9 == 2, "WorldCup2026 goals and worldcup2026 GOALS").when(k % 9 == 3, "World Cup 2026: the highlights").otherwise("Video"))
    return d.select(F.concat(F.lit("v"), k.cast("string")).alias("video_id"),
                    F.concat(title, F.lit(" "), F.coalesce("html", F.lit(""))).alias("title"),
                    (F.lit("2026-05-20 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(k.cast("int"))).alias("published_at"))


# Search phrases besides the fixed ones: of one to three words, frequent and unknown.
MORE_PHRASES = ["the", "in the", "of the", "class p", "charset utf 8", "no such phrase", "Goals"]


def listings_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poll listings from ``conversations``: a comment first listed in cycle (7 conv + turn) % 12, again in
    the next cycle (even turns), 40 cycles later (every third turn) and twice a cycle (conv % 5 = 0)."""
    d, c, t = table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    first = (c * 7 + t) % 12
    cycles = F.filter(F.array(first, F.when(t % 2 == 0, first + 1), F.when(t % 3 == 0, first + 40)), lambda x: x.isNotNull())
    d = d.select("conv_id", "turn", F.explode(cycles).alias("cycle"))
    d = d.withColumn("slot", F.explode(F.when(c % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return d.select("cycle", _from_start(F.col("cycle") * 600).alias("poll_ts"), F.concat(F.lit("v"), c.cast("string")).alias("video_id"),
                    F.concat_ws("_", F.lit("c"), c.cast("string"), t.cast("string")).alias("comment_id"), "slot")
