"""Post enrichment and scoring (F01-F18) and the full preprocessing chain."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fansignal.functions import scoring as sc
from fansignal.functions import text as tx
from fansignal.functions.common import epoch_seconds
from fansignal.operators import dedup as dd
from fansignal.operators import sentiment as sent
from fansignal.operators.topk import top_k_per_group
from fansignal.sources.tables import staged


def preprocess(posts: DataFrame, as_of: Column, id_col: str = "post_id", ts_col: str = "timestamp",
               text_col: str = "text", dedup: str = "keep_first", half_life_minutes: float = 30.0) -> DataFrame:
    """spam filter -> clean -> English only -> de-duplicate -> weights.

    Cheap filters run before the costly ones; ``dedup`` is 'keep_first' (exact E05),
    'rolling' (greedy E06 per source) or 'none'."""
    cols = posts.columns
    score = F.col("score") if "score" in cols else F.lit(None).cast("int")
    likes = F.col("like_count") if "like_count" in cols else F.lit(None).cast("int")
    author = F.col("author") if "author" in cols else F.lit(None).cast("string")
    p = posts.filter(~tx.is_spam(author, score, F.col(text_col)))
    p = tx.clean_rows(p.withColumn("text_original", F.col(text_col)), text_col, text_col)
    p = p.filter(tx.detect_language(F.col(text_col)).isin("en", "unknown"))
    if dedup == "keep_first":
        p = staged(p, "cleaned", "zstd")        # read twice: for the shingles and for what is kept
        p = dd.keep_first(p, id_col=id_col, ts_col=ts_col, text_col=text_col)
    elif dedup == "rolling":
        src = ["source"] if "source" in cols else []
        p = dd.rolling_dedup(p, src or [id_col], [ts_col, id_col], text_col=text_col)
    return (p.withColumn("time_decay_weight", sc.time_decay_weight(F.col(ts_col), as_of, half_life_minutes))
             .withColumn("engagement_weight", sc.engagement_weight(score, likes)))


def score_posts(posts: DataFrame, text_col: str = "text", scorer=None) -> DataFrame:
    """add sentiment_label / sentiment_score. Default scorer is the built-in
    lexicon (a JVM map lookup per token); ``scorer`` may be any Column -> struct
    function, e.g. an iterator pandas UDF that loads an external model once per worker."""
    fn = scorer or sc.lexicon_score
    s = fn(F.col(text_col))
    return posts.withColumn("_s", s).select("*", F.col("_s.sentiment_label").alias("sentiment_label"),
                                            F.col("_s.sentiment_score").alias("sentiment_score")).drop("_s")


def with_fallback(primary: Column, fallback: Column) -> Column:
    """the primary scorer's struct, or the fallback when the primary failed (NULL)."""
    return F.coalesce(primary, fallback)


def filter_entities(entities: Column) -> Column:
    """PER / ORG only, trimmed name longer than 1 char, first per case-folded name,
    score rounded to 4 places."""
    kept = F.filter(entities, lambda e: e["type"].isin("PER", "ORG") & (F.length(F.trim(e["name"])) > 1))
    firsts = F.aggregate(
        kept, F.array().cast("array<struct<name:string,type:string,score:double>>"),
        lambda acc, e: F.when(F.exists(acc, lambda a: F.lower(a["name"]) == F.lower(F.trim(e["name"]))), acc)
        .otherwise(F.concat(acc, F.array(F.struct(F.trim(e["name"]).alias("name"), e["type"].alias("type"),
                                                  F.round(e["score"], 4).alias("score"))))))
    return firsts


def gazetteer_entities(posts: DataFrame, names: DataFrame, post_id: str = "post_id", text_col: str = "text",
                       name_col: str = "name", type_col: str = "type") -> DataFrame:
    """entities from a name table (teams -> ORG, players -> PER): every token of the
    name, in order and next to each other. Returns (post_id, entities) with entities in
    first-mention order. Null names and names without a letter or digit match nothing."""
    pt = posts.select(F.col(post_id).alias("post_id"),
                      F.posexplode(sent._tok(F.col(text_col))).alias("pos", "token"))
    nt = names.select(F.col(name_col).alias("name"), F.col(type_col).alias("type")).distinct() \
        .withColumn("_toks", sent._tok(F.col("name")))
    nt = nt.select("name", "type", F.size("_toks").alias("n"), F.posexplode("_toks").alias("at", "token"))
    mention = (pt.join(nt, "token").groupBy("post_id", "name", "type", "n", (F.col("pos") - F.col("at")).alias("pos"))
               .agg(F.count(F.lit(1)).alias("found")).filter(F.col("found") == F.col("n")))
    hit = mention.groupBy("post_id", "name", "type").agg(F.min("pos").alias("pos"))
    return hit.groupBy("post_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "type"))),
                                                  lambda s: F.struct(s["name"].alias("name"), s["type"].alias("type"),
                                                                     F.lit(1.0).alias("score"))).alias("entities"))


def scored_post_projection(posts: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """the indexed document shape with the reference defaults."""
    cols = set(posts.columns)

    def c(name, default=None, dtype="string"):
        return F.col(name) if name in cols else F.lit(default).cast(dtype)
    src_id = F.coalesce(c("source_id"), c("id"))
    return posts.select(
        c("text").alias("text"), F.coalesce(c("source"), F.lit("unknown")).alias("source"),
        src_id.alias("source_id"), c("author").alias("author"), c("subreddit").alias("subreddit"),
        c("video_title").alias("video_title"), c("sentiment_label").alias("sentiment_label"),
        c("sentiment_score", None, "double").alias("sentiment_score"),
        (F.col("entities") if "entities" in cols else
         F.array().cast("array<struct<name:string,type:string,score:double>>")).alias("entities"),
        c("match_phase").alias("match_phase"),
        F.coalesce(c("time_decay_weight", None, "double"), F.lit(1.0)).alias("time_decay_weight"),
        F.coalesce(c("engagement_weight", None, "double"), F.lit(1.0)).alias("engagement_weight"),
        c("timestamp", None, "timestamp").alias("timestamp"),
        (processed_at if processed_at is not None else F.current_timestamp()).alias("processed_at"))


def assign_matches(posts: DataFrame, pairs: DataFrame, matches: DataFrame, post_id: str = "post_id",
                   ts_col: str = "timestamp") -> DataFrame:
    """for each post, the nearest kick-off among matches of a team it mentions
    (``pairs`` = H02 output), then F03 phase; of equally near ones the smallest match_id.
    Posts without a team or a time get no match and phase 'unknown'.

    Each mention meets one row of a (team, day) calendar that holds the kick-offs that can
    be nearest on that day, so the join makes one row per mention."""
    near = kick_off_calendar(matches)
    span = near.groupBy("team").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    p = posts.select(F.col(post_id).alias("post_id"), F.col(ts_col).alias("ts")).filter(F.col("ts").isNotNull())
    asked = pairs.join(p, "post_id").join(span, "team").select(
        "post_id", "team", "ts", F.greatest("first_day", F.least("last_day", F.to_date("ts"))).alias("day"))
    nearest = F.array_min(F.transform("kick_offs", lambda k: F.struct(
        F.abs(epoch_seconds("ts") - epoch_seconds(k["utc_date"])).alias("away"), k["match_id"].alias("match_id"),
        k["utc_date"].alias("utc_date"))))
    best = (asked.join(near, ["team", "day"]).select("post_id", nearest.alias("m"))
            .groupBy("post_id").agg(F.min("m").alias("m")))
    out = posts.join(best.withColumnRenamed("post_id", post_id), post_id, "left")
    return (out.withColumn("match_id", F.col("m.match_id"))
               .withColumn("match_phase", sc.match_phase(F.col(ts_col), F.col("m.utc_date"))).drop("m"))


def kick_off_calendar(matches: DataFrame) -> DataFrame:
    """(team, day, kick_offs) for each day from a team's first match to its last: the day's
    kick-offs (of a day without any, those of the last day before that has some), the one before and the
    one after them. Matches that start together count once, by their smallest match_id."""
    side = matches.filter(F.col("utc_date").isNotNull()).select(
        "match_id", "utc_date", F.explode(F.array("home_team", "away_team")).alias("team"))
    kick = side.groupBy("team", "utc_date").agg(F.min("match_id").alias("match_id"))
    days = kick.groupBy("team", F.to_date("utc_date").alias("day")).agg(
        F.array_sort(F.collect_list(F.struct("utc_date", "match_id"))).alias("kicks"))
    w = Window.partitionBy("team").orderBy("day")
    days = days.select("team", "day", "kicks", F.lag(F.element_at("kicks", -1)).over(w).alias("before"),
                       F.lead(F.element_at("kicks", 1)).over(w).alias("after"), F.lead("day").over(w).alias("next_day"))
    until = F.coalesce(F.date_sub("next_day", 1), "day")
    around = F.filter(F.concat("kicks", F.array("before", "after")), lambda k: k.isNotNull())
    return days.select("team", F.explode(F.sequence("day", until)).alias("day"), around.alias("kick_offs"))


def aggregate_sentiment(posts: DataFrame, keys: list[str], as_of: Column, use_time_decay: bool = True,
                        ts_col: str = "timestamp") -> DataFrame:
    """avg, decay x engagement weighted avg, label ratios and count per group."""
    w = F.lit(1.0)
    if use_time_decay:
        w = w * sc.time_decay_weight(F.col(ts_col), as_of)
    w = w * sc.engagement_weight(F.col("score") if "score" in posts.columns else F.lit(None),
                                 F.col("like_count") if "like_count" in posts.columns else F.lit(None))
    s = F.coalesce(F.col("sentiment_score"), F.lit(0.5))
    lab = F.coalesce(F.col("sentiment_label"), F.lit("neutral"))
    n = F.count(F.lit(1))
    g = posts.withColumn("_w", w).groupBy(*keys).agg(
        F.avg(s).alias("avg_sentiment"), F.sum(s * F.col("_w")).alias("_sw"), F.sum("_w").alias("_w"),
        (F.count_if(lab == "positive") / n).alias("positive_ratio"),
        (F.count_if(lab == "negative") / n).alias("negative_ratio"),
        (F.count_if(lab == "neutral") / n).alias("neutral_ratio"), n.alias("post_count"))
    return g.select(*keys, "avg_sentiment",
                    F.when(F.col("_w") != 0, F.col("_sw") / F.col("_w")).otherwise(F.lit(0.5)).alias("weighted_sentiment"),
                    "positive_ratio", "negative_ratio", "neutral_ratio", "post_count")


def phase_breakdown(posts: DataFrame, keys: list[str], phase_col: str = "match_phase") -> DataFrame:
    """per group, map phase -> struct(avg, count)."""
    ph = F.coalesce(F.col(phase_col), F.lit("unknown"))
    g = posts.groupBy(*keys, ph.alias("phase")).agg(
        F.avg(F.coalesce(F.col("sentiment_score"), F.lit(0.5))).alias("avg"), F.count(F.lit(1)).alias("count"))
    return g.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("phase", F.struct("avg", "count"))))
                                .alias("phase_breakdown"))


def with_empty_defaults(agg: DataFrame, keys: DataFrame, key_cols: list[str]) -> DataFrame:
    """F16: groups without posts get avg 0.5, weighted 0.5, ratios 0, count 0."""
    j = keys.join(agg, key_cols, "left")
    return j.select(*key_cols,
                    *[F.coalesce(F.col(c), F.lit(0.5)).alias(c) for c in ("avg_sentiment", "weighted_sentiment")],
                    *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("positive_ratio", "negative_ratio", "neutral_ratio")],
                    F.coalesce(F.col("post_count"), F.lit(0)).alias("post_count"))


def match_thread_sample(posts: DataFrame, n: int = 30, match_col: str = "match_id", ts_col: str = "timestamp",
                        id_col: str = "post_id", text_col: str = "text") -> DataFrame:
    """the first n posts of each match as one bulleted text (bounded per match)."""
    top = top_k_per_group(posts.filter(F.col(match_col).isNotNull()), [match_col],
                          [F.col(ts_col), F.col(id_col)], n, salt_cols=[id_col])
    return top.groupBy(match_col).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", text_col))), lambda s: F.concat(F.lit("- "), s[text_col])),
        "\n").alias("sample"), F.count(F.lit(1)).alias("posts"))


def prediction_explanation(pred: DataFrame) -> DataFrame:
    """the facts of a prediction as one templated line."""
    return pred.withColumn("explanation", F.format_string(
        "%s vs %s: home %.1f%%, draw %.1f%%, away %.1f%%; form %.2f vs %.2f; sentiment %.3f vs %.3f",
        "home_team", "away_team", "home_win", "draw", "away_win", "home_form", "away_form",
        "home_sentiment", "away_sentiment"))
