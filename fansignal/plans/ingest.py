"""Registered queries of the provider payloads, video search and polls (B02, B03, B05-B10) with
their SQL twins. The SQL states the result from the tables, without any JSON."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fansignal.functions.text import RELEVANCE_KEYWORDS
from fansignal.sources import provider_fixtures as pf
from fansignal.sources import providers as pv


def b02_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.submission_posts(pf.submissions_v(spark, sf_dir))


def b03_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.comment_posts(pf.reddit_comments_v(spark, sf_dir))


def b05_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.tweet_posts(pf.tweets_v(spark, sf_dir), pf.now_col())


def b06_thread_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.thread_comments(pf.thread_pages_v(spark, sf_dir))


def b06_put_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads and items that no projection takes, by provider and reason."""
    aside = lambda df, name, at="$.id": pv.quarantined(df, id_path=at).select(F.lit(name).alias("provider"), "reason")
    threads = pv.thread_items(pf.thread_pages_v(spark, sf_dir)).filter("bad is not null")
    d = (aside(pf.submissions_v(spark, sf_dir), "submission")
         .unionByName(aside(pf.reddit_comments_v(spark, sf_dir), "comment"))
         .unionByName(aside(pf.tweets_v(spark, sf_dir), "tweet", "$.data.id"))
         .unionByName(threads.select(F.lit("thread").alias("provider"), F.col("bad").alias("reason"))))
    return d.groupBy("provider", "reason").agg(F.count(F.lit(1)).alias("payloads"))


def b07_seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.first_seen(pf.listings_v(spark, sf_dir), "comment_id", ["poll_ts", "slot"])


def b08_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    floor = F.lit(pv.PUBLISHED_AFTER).cast("timestamp_ntz")
    return pv.search_videos(pf.videos_v(spark, sf_dir), pv.SEARCH_PHRASES + pf.MORE_PHRASES, floor)


def b09_first_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.first_sight(pf.listings_v(spark, sf_dir))


def b10_poll_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.poll_counts(pf.listings_v(spark, sf_dir), F.expr("INTERVAL 2 HOURS"))


QUERIES = {f.__name__: f for f in (b02_submissions, b03_comments, b05_tweets, b06_thread_comments, b06_put_aside, b07_seen_ids,
                                   b08_search, b09_first_sight, b10_poll_counts)}

SPACE = r"[\t\n\x0b\f\r \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
START = f"TIMESTAMP '{pf.START}'"


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _relevant(t: str) -> str:
    return "(" + " OR ".join(f"contains(lower({t}), '{k}')" for k in RELEVANCE_KEYWORDS) + ")"


B02 = f"""
WITH s AS (SELECT *, {_strip("CASE WHEN doc_id % 8 = 0 THEN ' What a golazo #WorldCup2026' WHEN doc_id % 8 = 5 THEN 'FIFA world cup news' WHEN doc_id % 8 <> 3 THEN 'Matchday thread' ELSE '' END || ' ' || coalesce(text, '')")} AS t
           FROM documents WHERE doc_id % 29 <> 0 AND doc_id % 31 <> 0)
SELECT 'reddit' AS source, 't3_' || doc_id AS source_id, substr(t, 1, 2000) AS text,
  CASE WHEN doc_id % 7 = 0 THEN '[deleted]' ELSE 'user_' || doc_id END AS author, source AS subreddit,
  {START} + to_seconds(doc_id * 61) AS "timestamp"
FROM s WHERE {_relevant('t')}"""

B03 = f"""
WITH s AS (SELECT *, {_strip("CASE (conv_id + turn) % 4 WHEN 0 THEN chr(10) || ' World Cup: ' || text WHEN 1 THEN ' fifa 26 ' ELSE text END")} AS t
           FROM conversations WHERE NOT (conv_id % 31 = 0 AND turn = 1))
SELECT 'reddit' AS source, 't1_' || conv_id || '_' || turn AS source_id, substr(t, 1, 2000) AS text,
  CASE WHEN turn % 5 = 0 THEN '[deleted]' ELSE 'user_' || conv_id END AS author, role AS subreddit,
  {START} + to_seconds(conv_id * 600 + turn * 30) AS "timestamp"
FROM s WHERE {_relevant('t')} AND length(t) >= 10"""

B05 = f"""
SELECT 'twitter' AS source, doc_id::VARCHAR AS source_id, substr(coalesce(text, ''), 1, 2000) AS text,
  CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE (doc_id % 150)::VARCHAR END AS author,
  CASE WHEN doc_id % 4 IN (0, 1) THEN TIMESTAMP '{pf.NOW}' ELSE {START} + to_seconds(doc_id * 61) END AS "timestamp"
FROM documents WHERE doc_id % 29 <> 0"""

B06 = f"""
SELECT 'c_' || conv_id || '_' || turn AS comment_id, 'v' || conv_id AS video_id,
  CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE coalesce(text, '') END AS text,
  CASE WHEN turn % 5 = 0 THEN '' ELSE coalesce(role, '') END AS author,
  CASE WHEN turn % 7 = 6 OR turn % 3 = 0 THEN 0 ELSE turn * 11 END::INTEGER AS like_count,
  CASE WHEN turn % 4 = 0 THEN '' ELSE strftime({START} + to_seconds(conv_id * 600 + turn * 30), '%Y-%m-%dT%H:%M:%SZ') END AS published_at
FROM conversations WHERE (conv_id + turn) % 13 <> 0 AND conv_id % 31 <> 0"""

B06_ASIDE = """
SELECT provider, reason, count(*) AS payloads FROM (
  SELECT 'submission' AS provider, CASE WHEN doc_id % 31 = 0 THEN 'malformed' ELSE 'no id' END AS reason FROM documents WHERE doc_id % 31 = 0 OR doc_id % 29 = 0
  UNION ALL SELECT 'comment', 'malformed' FROM conversations WHERE conv_id % 31 = 0 AND turn = 1
  UNION ALL SELECT 'tweet', 'no id' FROM documents WHERE doc_id % 29 = 0
  UNION ALL SELECT 'thread', 'malformed' FROM (SELECT DISTINCT conv_id, turn // 100 FROM conversations WHERE conv_id % 31 = 0)
  UNION ALL SELECT 'thread', 'no id' FROM conversations WHERE (conv_id + turn) % 13 = 0 AND conv_id % 31 <> 0)
GROUP BY 1, 2"""

LISTINGS = f"""WITH f AS (SELECT conv_id, turn, (conv_id * 7 + turn) % 12 AS c0 FROM conversations),
c AS (SELECT conv_id, turn, c0 AS cycle FROM f UNION ALL SELECT conv_id, turn, c0 + 1 FROM f WHERE turn % 2 = 0
      UNION ALL SELECT conv_id, turn, c0 + 40 FROM f WHERE turn % 3 = 0),
l AS (SELECT cycle, {START} + to_seconds(cycle * 600) AS poll_ts, 'v' || conv_id AS video_id, 'c_' || conv_id || '_' || turn AS comment_id, s AS slot
      FROM c, (VALUES (0), (1)) AS x(s) WHERE s = 0 OR conv_id % 5 = 0)
"""

B07 = LISTINGS + """SELECT cycle, poll_ts, video_id, comment_id, slot
FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY poll_ts, slot) AS rn FROM l) WHERE rn = 1"""

B09 = LISTINGS + """SELECT video_id, cycle, count(*) AS listed, cycle = min(cycle) OVER (PARTITION BY video_id) AS new_video
FROM l GROUP BY video_id, cycle"""

B10 = LISTINGS + """, p AS (SELECT comment_id, cycle, poll_ts, count(*) AS n FROM l GROUP BY ALL),
b AS (SELECT *, max(poll_ts) OVER (PARTITION BY comment_id ORDER BY poll_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
SELECT cycle, sum(n)::BIGINT AS listed, count(*) FILTER (WHERE before IS NULL) AS new_comments,
  (sum(n) - count(*) FILTER (WHERE before IS NULL))::BIGINT AS repeats,
  count(*) FILTER (WHERE poll_ts - before > INTERVAL 2 HOURS) AS late_repeats
FROM b GROUP BY cycle"""

_PHRASES = ", ".join(f"('{p}')" for p in pv.SEARCH_PHRASES + pf.MORE_PHRASES)
B08 = rf"""
WITH v AS (SELECT 'v' || page_id AS video_id, TIMESTAMP '2026-05-20' + to_days(page_id::INTEGER) AS published_at,
  regexp_extract_all(lower(CASE page_id % 9 WHEN 0 THEN 'World Cup 2026 highlights' WHEN 1 THEN 'FIFA World-Cup 2026 match day'
    WHEN 2 THEN 'WorldCup2026 goals and worldcup2026 GOALS' WHEN 3 THEN 'World Cup 2026: the highlights' ELSE 'Video' END || ' ' || coalesce(html, '')), '[\p{{L}}\p{{N}}]+') AS w
  FROM pages),
p AS (SELECT phrase, regexp_extract_all(lower(phrase), '[\p{{L}}\p{{N}}]+') AS pw FROM (VALUES {_PHRASES}) AS x(phrase)),
t AS (SELECT video_id, published_at, w, unnest(generate_series(1, len(w))) AS i FROM v WHERE published_at >= TIMESTAMP '{pv.PUBLISHED_AFTER}'),
m AS (SELECT phrase, video_id, published_at, count(*) AS n FROM t JOIN p ON w[i] = pw[1] AND w[i:i + len(pw) - 1] = pw GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY published_at DESC, video_id) AS rank FROM m)
SELECT phrase, video_id, published_at, n, rank FROM r WHERE rank <= 5"""

ORACLE = {"b02_submissions": B02, "b03_comments": B03, "b05_tweets": B05, "b06_thread_comments": B06, "b06_put_aside": B06_ASIDE,
          "b07_seen_ids": B07, "b08_search": B08, "b09_first_sight": B09, "b10_poll_counts": B10}
