"""Text cleaning and filtering as Column functions.

Everything except Unicode NFKD runs as JVM expressions (regexes, and higher-order functions where
a value is used several times). ``(?U)`` makes \\w, \\b, \\s and \\d Unicode-aware, as in the reference's Python regexes.
NFKD has no Spark built-in, so it is one Arrow UDF that skips ASCII rows.
"""
from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fansignal.functions.common import let

# Fixed values that must equal the reference: slang rewriting rules, applied in this order.
SLANG_RULES = [
    (r"\bworldie\b", "amazing goal"),
    (r"\bbanger\b", "great goal"),
    (r"\bgolazo\b", "spectacular goal"),
    (r"\btekkers\b", "great skill"),
    (r"\bsilky\b", "skillful"),
    (r"\bballed out\b", "played brilliantly"),
    (r"\b(top|pure) class\b", "excellent"),
    (r"\bon fire\b", "playing brilliantly"),
    (r"\bmagic\b", "excellent play"),
    (r"\bsensational\b", "outstanding"),
    (r"\blad\b", "player"),
    (r"\bhowler\b", "terrible mistake"),
    (r"\bshocker\b", "very poor performance"),
    (r"\bdisaster\b", "terrible performance"),
    (r"\brobbed\b", "unfairly defeated"),
    (r"\brobberry\b", "unfair result"),
    (r"\bparking the bus\b", "very defensive tactics"),
    (r"\bbottle job\b", "collapsed under pressure"),
    (r"\bfraud\b", "overrated player"),
    (r"\bbottled it\b", "failed under pressure"),
    (r"\bbad touch\b", "poor control"),
    (r"\bhoofball\b", "long ball tactics"),
    (r"\bgaffer\b", "manager"),
    (r"\bpitch\b", "field"),
    (r"\bkit\b", "uniform"),
    (r"\bbrace\b", "two goals"),
    (r"\bhat trick\b", "three goals"),
    (r"\bpen\b", "penalty"),
    (r"\bpens\b", "penalties"),
    (r"\bet\b", "extra time"),
    (r"\baet\b", "after extra time"),
    (r"\bvar\b", "video review"),
    (r"\bog\b", "own goal"),
]

# The patterns removed or replaced.
URL_RE = r"(?U)https?://\S+|www\.\S+"
MENTION_RE = r"(?U)@\w+"
HTML_RE = r"(?U)&[a-zA-Z]+;|&#\d+;"
MULTI_SPACE = r"(?U)\s{2,}"
EMOJI_RE = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F9FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
BOT_RE = r"(?i)bot$|^auto|^mod|_bot$|newsbot|feedbot"
REPEAT_RE = r"(.)\1{8,}"

# Relevance keywords (reddit) and the tweet track rule.
RELEVANCE_KEYWORDS = ["world cup", "worldcup", "fifa", "worldcup2026"]
TRACK_HASHTAGS = r"(?i)#(worldcup2026|fifaworldcup|worldcup)\b"


def strip_html_entities(t: Column) -> Column:
    """Entities are replaced by a space (not decoded)."""
    return F.regexp_replace(t, HTML_RE, " ")


def remove_urls(t: Column) -> Column:
    """D03."""
    return F.regexp_replace(t, URL_RE, "")


def remove_mentions(t: Column) -> Column:
    """D04."""
    return F.regexp_replace(t, MENTION_RE, "")


def unwrap_hashtags(t: Column) -> Column:
    """Known tags lose their '#', then every remaining '#' is removed. Removing all
    '#' gives the same text as both steps, so one ``replace`` does the work."""
    return F.replace(t, F.lit("#"), F.lit(""))


def _nfkd_strip(texts: pa.Array) -> pa.Array:
    """A slice of the batch at a time, so that few texts are Python strings at once."""
    def one(x):
        if x is None or x.isascii():
            return x
        d = unicodedata.normalize("NFKD", x)
        return "".join(c for c in d if not unicodedata.combining(c))
    slices = (texts.slice(i, 256).to_pylist() for i in range(0, len(texts), 256))
    return pa.chunked_array([pa.array(map(one, s), pa.string()) for s in slices], pa.string()).combine_chunks()


# Marked non-deterministic so that a filter on the result is not pushed below it, which
# would run it (and the chain above it) twice per row.
strip_accents_udf = F.arrow_udf(_nfkd_strip, T.StringType()).asNondeterministic()


def strip_accents(t: Column) -> Column:
    """Unicode NFKD and removal of combining marks (Arrow-batched). ASCII texts stay in
    the JVM: Python gets a NULL for them."""
    return F.coalesce(strip_accents_udf(F.when(t.rlike(r"[^\x00-\x7F]"), t)), t)


def remove_emoji(t: Column) -> Column:
    """The five code-point ranges -> one space (the last range also covers CJK etc.)."""
    return F.regexp_replace(t, EMOJI_RE, " ")


def _slang_phrases() -> dict[str, str]:
    """Every phrase that a rule rewrites, in lower case, with its replacement."""
    out = {}
    for pattern, new in SLANG_RULES:
        body = pattern.replace(r"\b", "")
        if m := re.match(r"\(([^)]*)\)(.*)", body):
            out.update({head + m[2]: new for head in m[1].split("|")})
        else:
            out[body] = new
    return out


def rewrite_slang(t: Column) -> Column:
    """The 33 rules in one pass. No rule's words occur in another's replacement or phrase, so
    applying them in order equals replacing every match of their alternation: the text is split
    at the matches, and each match is looked up."""
    phrases = _slang_phrases()
    any_of = r"(?iU)\b(?:" + "|".join(phrases) + r")\b"
    new = F.create_map(*[x for pair in phrases.items() for x in map(F.lit, pair)])

    def body(x):
        between, found = F.split(x, any_of, -1), F.regexp_extract_all(x, F.lit(any_of), F.lit(0))
        joined = F.zip_with(between, found, lambda gap, m: F.concat(gap, F.coalesce(F.try_element_at(new, F.lower(m)), m, F.lit(""))))
        return F.when(x.rlike(any_of), F.array_join(joined, "")).otherwise(x)
    return let(t, body)


def collapse_whitespace(t: Column) -> Column:
    """Runs of 2+ whitespace -> one space, then Unicode-aware strip."""
    return F.regexp_replace(F.regexp_replace(t, MULTI_SPACE, " "), r"(?U)^\s+|\s+$", "")


def word_count(t: Column) -> Column:
    """Number of whitespace-separated words (Python ``str.split()`` semantics)."""
    return F.regexp_count(t, F.lit(r"(?U)\S+"))


def letter_ratio(t: Column) -> Column:
    """Share of Unicode letters among all characters."""
    return F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) / F.greatest(F.length(t), F.lit(1))


def _before_accents(t: Column) -> Column:
    return unwrap_hashtags(remove_mentions(remove_urls(strip_html_entities(t))))


def _after_accents(t: Column) -> Column:
    return collapse_whitespace(rewrite_slang(remove_emoji(t)))


def _has_words(t: Column, n: int) -> Column:
    """At least ``n`` words; stops at the n-th."""
    return t.rlike(rf"(?U)\S(?:\S*\s+\S){{{n - 1}}}") if n > 0 else F.lit(True)


def clean_text(text: Column, min_words: int = 4, min_letter_ratio: float = 0.4) -> Column:
    """D01-D11 in the reference order; NULL means the post is discarded. For whole tables use
    ``clean_rows``: a filter on this column makes Spark evaluate parts of the chain again."""
    t = _after_accents(strip_accents(_before_accents(text)))

    def body(x):
        return F.when(_has_words(x, min_words) & (letter_ratio(x) >= min_letter_ratio), x)
    return F.when(text.isNull() | (text == ""), F.lit(None)).otherwise(let(t, body))


def clean_rows(df: DataFrame, text_col: str = "text", out_col: str = "text", min_words: int = 4,
               min_letter_ratio: float = 0.4) -> DataFrame:
    """D12 over a table: rows whose text survives, with the cleaned text. Each part of the chain is
    emitted by a generator, which filters, and which Spark neither repeats nor pushes below: the
    texts pass it once."""
    t = F.col(text_col)
    d = df.withColumn("_before", F.explode(F.when(t.isNotNull() & (t != ""), F.array(_before_accents(t)))))
    d = d.withColumn("_plain", strip_accents(F.col("_before")))

    def kept(x):
        return F.when(_has_words(x, min_words) & (letter_ratio(x) >= min_letter_ratio), F.array(x)).otherwise(F.array().cast("array<string>"))
    d = d.withColumn("_clean", F.explode(let(_after_accents(F.col("_plain")), kept)))
    return d.withColumn(out_col, F.col("_clean")).drop("_before", "_plain", "_clean")


def is_bot_author(author: Column) -> Column:
    """D13 (pattern as written: also matches names starting with 'mod' or 'auto')."""
    return F.coalesce(author, F.lit("")).rlike(BOT_RE)


def is_low_score(score: Column, threshold: int = -10) -> Column:
    """D14."""
    return F.coalesce(score, F.lit(0)) < threshold


def is_repeated_char_spam(text: Column) -> Column:
    """Some character 9+ times in a row and fewer than 3 words."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike(REPEAT_RE) & (word_count(t) < 3)


def is_spam(author: Column, score: Column, text: Column) -> Column:
    """D16."""
    return is_bot_author(author) | is_low_score(score) | is_repeated_char_spam(text)


def ascii_letter_ratio(t: Column) -> Column:
    return F.length(F.regexp_replace(t, "[^A-Za-z]+", "")) / F.greatest(F.length(t), F.lit(1))


def detect_language(t: Column) -> Column:
    """D17: 'en' when ASCII letters are more than 70 % of characters, else 'other'."""
    return F.when(ascii_letter_ratio(t) > 0.7, "en").otherwise("other")


def truncate(t: Column, n: int) -> Column:
    """D19."""
    return F.substring(t, 1, n)


def is_relevant(text: Column) -> Column:
    """Lower-cased text contains any of the keywords."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(k) for k in RELEVANCE_KEYWORDS])


def matches_track_rule(text: Column, lang: Column) -> Column:
    """One of the three tags and language 'en'."""
    return F.coalesce(text, F.lit("")).rlike(TRACK_HASHTAGS) & (lang == "en")
