"""Structured Streaming twins of the ingest operators (A01-A06, B07, E06, G02; B11 is in ``live``).

The same Column / DataFrame functions as the batch path run on streaming frames; state
is bounded by watermarks or by a fixed-size ring per source, and the sink (``sink``) takes every
micro-batch once.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from fansignal.functions import scoring as sc
from fansignal.functions import text as tx
from fansignal.operators import enrich as en
from fansignal.operators.dedup import RecentPosts, shingle_hashes
from fansignal.sources.schemas import POSTS_RAW
from fansignal.streaming.sink import write_epochs

# The three post topics.
TOPICS = ["reddit-posts", "twitter-posts", "youtube-comments"]


def read_posts(spark: SparkSession, path: str | None = None, kafka_servers: str | None = None,
               topics: list[str] | None = None, max_per_trigger: int | None = None) -> DataFrame:
    """Multi-topic JSON source from the earliest offset (Kafka), or a JSON file
    directory with the same schema (tests, replays)."""
    if kafka_servers:
        r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", kafka_servers)
             .option("subscribe", ",".join(topics or TOPICS)).option("startingOffsets", "earliest"))
        if max_per_trigger:
            r = r.option("maxOffsetsPerTrigger", max_per_trigger)
        raw = r.load()
        return raw.select(F.from_json(F.col("value").cast("string"), POSTS_RAW).alias("m")).select("m.*")
    r = spark.readStream.schema(POSTS_RAW)
    if max_per_trigger:
        r = r.option("maxFilesPerTrigger", max_per_trigger)
    return r.json(path)


def to_json_value(df: DataFrame) -> DataFrame:
    """One JSON ``value`` column (producer-side serializer)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def parse_post_time(posts: DataFrame) -> DataFrame:
    """ISO-8601 text with 'Z', an offset or no zone (read as UTC) -> timestamp; bad -> NULL."""
    return posts.withColumn("ts", F.coalesce(F.try_to_timestamp(F.col("timestamp")),
                                             F.try_to_timestamp(F.col("published_at"))))


def clean_and_score(posts: DataFrame) -> DataFrame:
    """Stateless part of F05 + F06 + F13 on a stream (spam, clean, English, score, project)."""
    p = parse_post_time(posts)
    p = p.filter(~tx.is_spam(F.col("author"), F.col("score"), F.col("text")))
    p = tx.clean_rows(p)
    p = p.filter(tx.detect_language(F.col("text")).isin("en", "unknown"))
    p = p.withColumn("engagement_weight", sc.engagement_weight(F.col("score"), F.col("like_count")))
    return en.score_posts(p)


def dedup_ids(posts: DataFrame, id_cols: list[str], watermark: str = "1 day", ts: str = "ts") -> DataFrame:
    """Seen-id de-duplication with bounded state (an id repeated after the watermark
    has passed is emitted again)."""
    return posts.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(id_cols)


def _admitted(size: int, threshold: float):
    def fn(key, pdfs, state):
        recent = RecentPosts(size, threshold)
        if state.exists:
            lengths, hashes = (np.frombuffer(x, np.int64) for x in state.get)
            for one in np.split(hashes, np.cumsum(lengths)[:-1]):
                recent.remember(one.tolist())
        pdf = pd.concat(list(pdfs)).sort_values(["ts", "id"], kind="stable")
        yield pdf[[recent.admits(h.tolist()) for h in pdf["_h"]]]
        kept = list(recent.hashes.values())
        state.update((np.array([len(h) for h in kept], np.int64).tobytes(),
                      np.array([x for h in kept for x in h], np.int64).tobytes()))
    return fn


def rolling_dedup_stream(posts: DataFrame, block_col: str = "source", window_size: int = 1000,
                         compare_last: int = 200, threshold: float = 0.8, k: int = 3) -> DataFrame:
    """E06 on a stream: per block, the hashes of the last kept posts are the state, so it never
    grows with the stream. A block's rows of one micro-batch are put in (ts, id) order
    together; the source's rate limit (``max_per_trigger``) bounds them."""
    p = posts.withColumn("_h", shingle_hashes(F.coalesce(F.col("text"), F.lit("")), k))
    state = T.StructType([T.StructField("lengths", T.BinaryType()), T.StructField("hashes", T.BinaryType())])
    return p.groupBy(block_col).applyInPandasWithState(
        _admitted(min(window_size, compare_last), threshold), p.schema, state, "append",
        GroupStateTimeout.NoTimeout).drop("_h")


def windowed_sentiment(posts: DataFrame, interval: str = "15 minutes", watermark: str = "1 hour",
                       ts: str = "ts") -> DataFrame:
    """G02 on a stream: tumbling-window average score with a watermark (append mode emits
    each bucket once it can no longer change)."""
    return (posts.withWatermark(ts, watermark).groupBy(F.window(ts, interval).alias("w"))
            .agg(F.avg("sentiment_score").alias("avg_score"), F.count(F.lit(1)).alias("doc_count"))
            .select(F.col("w.start").alias("bucket"), "avg_score", "doc_count"))


def write_posts(df: DataFrame, path: str, checkpoint: str, trigger: str | None = "10 seconds",
                available_now: bool = False, compact_every: int = 0):
    """Scored posts into an ``EpochTable`` partitioned by day, every micro-batch once;
    read them with ``EpochTable(spark, path).read()``. ``available_now`` drains everything
    present and stops (the final flush)."""
    return write_epochs(df.withColumn("day", F.to_date("ts")), path, checkpoint, trigger, available_now,
                        partition_by=["day"], compact_every=compact_every)


def write_matches(df: DataFrame, path: str, checkpoint: str, key: str = "match_id", order: str = "last_updated",
                  trigger: str | None = "60 seconds", available_now: bool = False, compact_every: int = 60):
    """A06 on a stream: match documents upserted by id, last write wins; the current table is
    ``EpochTable(spark, path).latest([key], [order])``."""
    return write_epochs(df, path, checkpoint, trigger, available_now, compact_every=compact_every, key=[key], order=[order])
