"""Provider payloads -> posts (B02, B03, B05, B06), video search (B08) and polls.

Payloads arrive as JSON text and are parsed once into VARIANT, so a field of another type or a
missing branch costs only that field: each path is read with its own default. A payload
that is no JSON, or lacks the id everything hangs on, is put aside with its reason instead of
failing the batch. All of it is row-local except where a shuffle is named.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fansignal.functions import text as tx
from fansignal.functions.common import let
from fansignal.operators.topk import top_k_per_group

MAX_TEXT = 2000            # fixed value: characters kept of a post
MIN_COMMENT = 10           # fixed value: shorter comments are dropped
# The search phrases, the publication floor and the number of videos per phrase.
SEARCH_PHRASES = ["World Cup 2026 highlights", "FIFA World Cup 2026 match", "WorldCup2026 goals"]
PUBLISHED_AFTER = "2026-06-01 00:00:00"
VIDEOS_PER_PHRASE = 5


def path(v: str | Column, at: str, kind: str = "string") -> Column:
    """A VARIANT path as ``kind``; NULL if the branch is missing, null or of another type."""
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, at, kind)


def parsed(payloads: DataFrame, payload_col: str = "payload", id_path: str = "$.id") -> DataFrame:
    """Payload rows with ``v`` (VARIANT) and ``bad``: 'malformed' for text that is no JSON (or
    NULL), 'no id' for a payload without the id, else NULL."""
    d = payloads.withColumn("v", F.try_parse_json(F.col(payload_col)))
    bad = F.when(F.col("v").isNull(), "malformed").when(path("v", id_path).isNull(), "no id")
    return d.withColumn("bad", bad)


def quarantined(payloads: DataFrame, payload_col: str = "payload", id_path: str = "$.id") -> DataFrame:
    """The payloads put aside, unchanged, with their reason."""
    d = parsed(payloads, payload_col, id_path).filter(F.col("bad").isNotNull())
    return d.select(*payloads.columns, F.col("bad").alias("reason"))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _epoch(c: Column) -> Column:
    return F.timestamp_seconds(c).cast("timestamp_ntz")


def _reddit_posts(d: DataFrame, text: Column) -> DataFrame:
    d = d.filter(F.col("bad").isNull()).withColumn("_text", stripped(text))
    return d.filter(tx.is_relevant(F.col("_text"))).select(
        F.lit("reddit").alias("source"), path("v", "$.id").alias("source_id"), F.col("_text").alias("text"),
        F.coalesce(path("v", "$.author.name"), F.lit("[deleted]")).alias("author"),
        path("v", "$.subreddit.display_name").alias("subreddit"), _epoch(path("v", "$.created_utc", "double")).alias("timestamp"))


def submission_posts(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Title and body joined by a space, stripped, relevant ones only, cut to 2000
    characters after the relevance test; a deleted author becomes '[deleted]'; epoch -> UTC."""
    d = parsed(payloads, payload_col)
    both = F.concat(F.coalesce(path("v", "$.title"), F.lit("")), F.lit(" "), F.coalesce(path("v", "$.selftext"), F.lit("")))
    return _reddit_posts(d, both).withColumn("text", tx.truncate(F.col("text"), MAX_TEXT))


def comment_posts(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """As B02 over the comment body, without bodies of fewer than 10 characters."""
    d = _reddit_posts(parsed(payloads, payload_col), F.coalesce(path("v", "$.body"), F.lit("")))
    return d.filter(F.length("text") >= MIN_COMMENT).withColumn("text", tx.truncate(F.col("text"), MAX_TEXT))


def tweet_posts(payloads: DataFrame, now: Column, payload_col: str = "payload") -> DataFrame:
    """Text cut to 2000 characters, author 'unknown' and time ``now`` where missing."""
    d = parsed(payloads, payload_col, "$.data.id").filter(F.col("bad").isNull())
    return d.select(
        F.lit("twitter").alias("source"), path("v", "$.data.id").alias("source_id"),
        tx.truncate(F.coalesce(path("v", "$.data.text"), F.lit("")), MAX_TEXT).alias("text"),
        F.coalesce(path("v", "$.data.author_id"), F.lit("unknown")).alias("author"),
        F.coalesce(F.try_to_timestamp(path("v", "$.data.created_at")).cast("timestamp_ntz"), now).alias("timestamp"))


def thread_items(pages: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Comment-thread pages -> one row per item with ``item`` (VARIANT) and ``bad``: 'malformed'
    for a page that is no JSON or has no item list (one row), 'no id' for an item without id
    or snippet."""
    d = pages.withColumn("v", F.try_parse_json(F.col(payload_col)))
    items = F.try_variant_get("v", "$.items", "array<variant>")
    d = d.withColumn("item", F.explode_outer(F.when(items.isNotNull(), items).otherwise(F.array(F.lit(None).cast("variant")))))
    snippet = F.try_variant_get("item", "$.snippet.topLevelComment.snippet", "variant")
    no_id = path("item", "$.id").isNull() | snippet.isNull()
    # an empty page has no item and is not bad
    return (d.withColumn("bad", F.when(F.col("v").isNull() | items.isNull(), "malformed").when(F.col("item").isNotNull() & no_id, "no id"))
            .filter(F.col("item").isNotNull() | F.col("bad").isNotNull()).drop("v"))


def thread_comments(pages: DataFrame, payload_col: str = "payload", video_col: str = "video_id") -> DataFrame:
    """comment_id, video_id, text, author, like_count and published_at of every thread item,
    with '' / '' / 0 / '' where a field is missing or of another type."""
    s = "$.snippet.topLevelComment.snippet"
    d = thread_items(pages, payload_col).filter(F.col("bad").isNull())
    return d.select(
        path("item", "$.id").alias("comment_id"), F.col(video_col).alias("video_id"),
        F.coalesce(path("item", f"{s}.textDisplay"), F.lit("")).alias("text"),
        F.coalesce(path("item", f"{s}.authorDisplayName"), F.lit("")).alias("author"),
        F.coalesce(path("item", f"{s}.likeCount", "int"), F.lit(0)).alias("like_count"),
        F.coalesce(path("item", f"{s}.publishedAt"), F.lit("")).alias("published_at"))


# ---- B08 video search ----------------------------------------------------------------

def word_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _runs_from(words: Column, heads: list[str], k: int) -> Column:
    """Every run of ``k`` words that begins with one of ``heads``, joined by spaces."""
    places = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
    begun = F.filter(places, lambda i: F.element_at(words, i).isin(heads))
    return F.transform(begun, lambda i: F.array_join(F.slice(words, i, k), " "))


def phrase_matches(videos: DataFrame, phrases: list[str], text_col: str, id_col: str) -> DataFrame:
    """(id, phrase, n): the phrases whose words occur in a text one after the other, and how often.

    The phrases are grouped by their number of words, as a trie flattened level by level: at a
    position whose word begins a phrase of so many words, the run of that length is taken
    and looked up in one equi join. A text is split into words once, and positions that begin
    no phrase make no row; so the work is linear in the words, times the few different
    phrase lengths, however many phrases the caller gives."""
    spark = videos.sparkSession
    words = {p: re.findall(r"[^\W_]+", p.lower()) for p in phrases}
    table = spark.createDataFrame([(p, " ".join(w)) for p, w in words.items() if w], "phrase string, run string")
    heads: dict[int, set[str]] = {}
    for w in words.values():
        if w:
            heads.setdefault(len(w), set()).add(w[0])
    if not heads:
        return videos.select(F.col(id_col).alias("id"), F.lit("").alias("phrase"), F.lit(0).cast("long").alias("n")).filter("false")
    runs = let(word_tokens(F.col(text_col)), lambda w: F.concat(*[_runs_from(w, sorted(h), k) for k, h in sorted(heads.items())]))
    t = videos.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    return t.join(F.broadcast(table), "run").groupBy("id", "phrase").agg(F.count(F.lit(1)).alias("n"))    # the caller's list


def search_videos(videos: DataFrame, phrases: list[str], floor: Column, newest: int = VIDEOS_PER_PHRASE,
                  id_col: str = "video_id", text_col: str = "title", time_col: str = "published_at") -> DataFrame:
    """Per phrase the newest videos that hold it and are not older than ``floor``; ties by id."""
    v = videos.filter(F.col(time_col) >= floor)
    m = phrase_matches(v, phrases, text_col, id_col).withColumnRenamed("id", id_col)
    m = m.join(v.select(id_col, time_col), id_col)
    return top_k_per_group(m.select("phrase", id_col, time_col, "n"), ["phrase"], [F.col(time_col).desc(), F.col(id_col).asc()], newest)


# ---- B07, B09, B10 polls ---------------------------------------------------------------

def first_seen(listings: DataFrame, key: str, order: list[str]) -> DataFrame:
    """B07 in batch: the first listing of every key; one partial aggregation, no window."""
    rest = [c for c in listings.columns if c not in (key, *order)]
    return (listings.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("s")).select(key, "s.*").select(*listings.columns))


def first_sight(listings: DataFrame, key: str = "video_id", cycle: str = "cycle") -> DataFrame:
    """One row per (cycle, key) with the flag whether the key was never listed before."""
    per = listings.groupBy(key, cycle).agg(F.count(F.lit(1)).alias("listed"))
    w = Window.partitionBy(key).orderBy(cycle)      # a key's rows are its poll cycles
    return per.withColumn("new_video", F.lag(cycle).over(w).isNull())


def poll_counts(listings: DataFrame, horizon: Column, key: str = "comment_id", cycle: str = "cycle", time: str = "poll_ts") -> DataFrame:
    """Per poll cycle the comments listed, how many are new (first listing ever by time), how
    many are repeats, and how many of these come more than ``horizon`` after the listing
    before, that is, which a stream with that watermark would no longer recognise.

    Listings of one cycle and comment are counted first, so the window runs over the cycles of
    a comment, not over its rows."""
    per = listings.groupBy(key, cycle).agg(F.min(time).alias("at"), F.count(F.lit(1)).alias("n"))
    before = F.lag("at").over(Window.partitionBy(key).orderBy("at", cycle))
    d = per.withColumn("before", before)
    new, late = F.col("before").isNull(), F.col("before") + horizon < F.col("at")
    return d.groupBy(cycle).agg(
        F.sum("n").alias("listed"), F.count_if(new).alias("new_comments"),
        (F.sum("n") - F.count_if(new)).alias("repeats"), F.count_if(late).alias("late_repeats"))
