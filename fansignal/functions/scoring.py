"""Column functions for post weights, match phase and lexicon sentiment."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fansignal.functions.common import epoch_seconds


def time_decay_weight(ts: Column, as_of: Column, half_life_minutes: float = 30.0,
                      clamp: bool = False) -> Column:
    """0.5 ** (age_minutes / half_life); NULL timestamp -> 1.0. Future posts get > 1
    (as the reference) unless ``clamp``."""
    age_min = (epoch_seconds(as_of) - epoch_seconds(ts)) / 60.0
    if clamp:
        age_min = F.greatest(age_min, F.lit(0.0))
    return F.coalesce(F.pow(F.lit(0.5), age_min / F.lit(float(half_life_minutes))), F.lit(1.0))


def engagement_weight(score: Column, like_count: Column) -> Column:
    """min(1 + ln(1 + max(score + likes, 0)) / 5, 5); NULL counts as 0."""
    e = F.coalesce(score, F.lit(0)) + F.coalesce(like_count, F.lit(0))
    return F.least(F.lit(5.0), F.lit(1.0) + F.log1p(F.greatest(e.cast("double"), F.lit(0.0))) / 5.0)


def match_phase(post_ts: Column, match_ts: Column) -> Column:
    """< -2h pre_match, > +3h post_match, else live; NULL input -> unknown."""
    dh = (epoch_seconds(post_ts) - epoch_seconds(match_ts)) / 3600.0
    return (F.when(dh.isNull(), "unknown").when(dh < -2, "pre_match")
            .when(dh > 3, "post_match").otherwise("live"))


TOKEN_SPLIT = r"[^\p{L}\p{N}_']+"


def tokens(text: Column, keep_apostrophe: bool = True) -> Column:
    """Lower-case word tokens (letters, digits, '_' and apostrophes), empties dropped."""
    pat = TOKEN_SPLIT if keep_apostrophe else r"[^\p{L}\p{N}_]+"
    return F.filter(F.split(F.lower(text), pat), lambda t: t != "")


# The built-in polarity lexicon (our own word list, +1 / -1).
POSITIVE_WORDS = ["amazing", "great", "spectacular", "skill", "skillful", "brilliantly",
                  "excellent", "outstanding", "win", "won", "good", "best", "love", "superb",
                  "fantastic", "beautiful", "happy", "incredible", "perfect", "wonderful"]
NEGATIVE_WORDS = ["terrible", "poor", "unfairly", "unfair", "defeated", "collapsed", "failed",
                  "overrated", "bad", "worst", "hate", "awful", "mistake", "disaster", "lost",
                  "lose", "angry", "sad", "horrible", "boring"]


def lexicon_map() -> Column:
    kv = [x for w in POSITIVE_WORDS for x in (F.lit(w), F.lit(1))]
    kv += [x for w in NEGATIVE_WORDS for x in (F.lit(w), F.lit(-1))]
    return F.create_map(*kv)


def lexicon_polarity(text: Column) -> Column:
    """struct(hits, polarity) over the tokens of ``text``; map lookups stay in codegen."""
    lm = lexicon_map()
    vals = F.transform(tokens(text), lambda t: F.element_at(lm, t))
    hits = F.size(F.filter(vals, lambda v: v.isNotNull()))
    pol = F.aggregate(vals, F.lit(0), lambda acc, v: acc + F.coalesce(v, F.lit(0)))
    return F.struct(hits.alias("hits"), pol.alias("polarity"))


def lexicon_score(text: Column) -> Column:
    """F06 built-in scorer: struct(sentiment_label, sentiment_score) with score in [0, 1],
    0.5 neutral; empty or NULL text -> neutral 0.5 (F07)."""
    p = lexicon_polarity(F.coalesce(text, F.lit("")))
    score = F.when(p.hits > 0, F.lit(0.5) + F.lit(0.5) * p.polarity / p.hits).otherwise(F.lit(0.5))
    label = F.when(p.polarity > 0, "positive").when(p.polarity < 0, "negative").otherwise("neutral")
    return F.struct(label.alias("sentiment_label"), score.cast("double").alias("sentiment_score"))


# Label passthrough map of the local scorer.
LABEL_MAP = {"positive": "positive", "negative": "negative", "neutral": "neutral"}


def map_label(raw: Column) -> Column:
    """lower-cased lookup with passthrough of unknown labels."""
    m = F.create_map(*[F.lit(x) for kv in LABEL_MAP.items() for x in kv])
    return F.coalesce(F.element_at(m, F.lower(raw)), raw)


MODEL_OUTPUT_SCHEMA = ("sentiment_label string, sentiment_score double, confidence double, "
                       "entities array<struct<name:string,type:string,score:double>>, reasoning string")


def parse_model_output(raw: Column) -> Column:
    """JSON model answer -> struct with per-field defaults; unparsable -> NULL struct."""
    p = F.from_json(raw, MODEL_OUTPUT_SCHEMA)
    return F.when(p.isNull(), F.lit(None)).otherwise(F.struct(
        F.coalesce(p.sentiment_label, F.lit("neutral")).alias("sentiment_label"),
        F.coalesce(p.sentiment_score, F.lit(0.5)).alias("sentiment_score"),
        F.coalesce(p.confidence, F.lit(1.0)).alias("confidence"),
        F.coalesce(p.entities, F.array().cast("array<struct<name:string,type:string,score:double>>"))
         .alias("entities"),
        F.coalesce(p.reasoning, F.lit("")).alias("reasoning")))


def confidence_to_polarity(label: Column, confidence: Column) -> Column:
    """SURVEY 7.4-2: label confidence -> polarity in [0, 1] (positive .5+c/2, negative .5-c/2)."""
    return (F.when(label == "positive", 0.5 + confidence / 2)
            .when(label == "negative", 0.5 - confidence / 2).otherwise(F.lit(0.5)))
