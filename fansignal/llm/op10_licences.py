"""Licence scan by canonical digests, DataFrame functions only.

A text is made canonical: lower case; copyright lines dropped (the line starts with
"copyright", "(c)" or the sign, or says only "all rights reserved"); everything but letters
and digits becomes one space; equivalent spellings become one. Two texts that differ in
these things only have one SHA-256 digest, and entire texts are joined to the digests of
the known licences. The entire text of a document is looked up, and the entire text of
each of its lines (there, copyright lines are kept, as "all rights reserved" is a notice of
its own).

Known licences up to SMALL rows are sent to every task, larger tables meet in a shuffle
join. Nulls and empties: null or blank texts and lines match nothing. Rows that repeat a
doc_id give one row each, looked at each for itself. Known rows without id or text are
ignored.
"""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fansignal.functions.common import let
from fansignal.llm.licence_texts import KNOWN

SMALL = 100_000
# On lower-cased texts. The words in COPYRIGHT_SIGNS tell cheaply where the pattern can match.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©]*(?:copyright\b|\(c\)|©|all rights reserved[^\p{L}\p{N}\n]*$)[^\n]*$"
COPYRIGHT_SIGNS = ("copyright", "(c)", "©", "all rights reserved")
NOT_WORD = r"[^a-z0-9\p{L}\p{N}]+"
# Spellings that licence scans treat as equal, applied in this order.
SPELLINGS = [
    (r"\blicence", "license"), (r"\bsub license", "sublicense"), (r"\bsublicence", "sublicense"),
    (r"\bnon commercial", "noncommercial"), (r"\bnon infringement", "noninfringement"),
    (r"\bcopyright owner", "copyright holder"), (r"\backnowledgement", "acknowledgment"),
    (r"\borganisation", "organization"), (r"\brecognis", "recogniz"),
    (r"\bfavour", "favor"), (r"\bjudgement", "judgment"), (r"\bwhilst\b", "while"), (r"\bper cent\b", "percent"),
    (r"\bhttps\b", "http"), (r"\bversion (\d)", "v $1"),
]


def _has(text: Column, words) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(text, F.lit(w)) for w in words])


def canonical(text: Column, whole: bool) -> Column:
    """Canonical form of an entire text; copyright lines are dropped from whole texts."""
    t = F.lower(F.coalesce(text, F.lit("")))
    if whole:
        t = let(t, lambda c: F.when(_has(c, COPYRIGHT_SIGNS), F.regexp_replace(c, COPYRIGHT_LINE, "")).otherwise(c))
    t = F.trim(F.regexp_replace(t, NOT_WORD, " "))
    plain = [re.sub(r"\\b|\(.*\)", "", p) for p, _ in SPELLINGS]    # no spelling applies without one of these
    return let(t, lambda c: F.when(_has(c, plain), reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), SPELLINGS, c))
               .otherwise(c))


def digest(text: Column, whole: bool) -> Column:
    """SHA-256 of the canonical form, null if nothing is left."""
    return let(canonical(text, whole), lambda c: F.when(c != "", F.sha2(c, 256)))


def known_licences(spark: SparkSession) -> DataFrame:
    """(licence, text) of the built-in wordings."""
    rows = [F.struct(F.lit(a).alias("licence"), F.lit(b).alias("text")) for a, b in KNOWN]
    return spark.range(1).select(F.inline(F.array(*rows)))


def licence_scan(documents: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, licence, notices, n_notice_lines) per row: digest of the
    canonical text, licence whose entire text it is (smallest id if several), sorted ids
    of the licences whose entire wording is a line, and how many lines are one."""
    d = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("version", F.xxhash64("text"))
    usable = known.filter("licence is not null and text is not null")

    def digests(whole):
        k = (usable.select("licence", digest(F.col("text"), whole).alias("digest")).filter("digest is not null")
             .groupBy("digest").agg(F.min("licence").alias("licence")))
        return F.broadcast(k) if known.count() <= SMALL else k

    lines = d.select("doc_id", "version", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    notices = (lines.select("doc_id", "version", digest(F.col("line"), False).alias("digest")).join(digests(False), "digest")
               .groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("licence")).alias("notices"),
                                                 F.count(F.lit(1)).alias("n")))
    rows = d.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("copies"))
    per = notices.join(rows, notices.doc_id.eqNullSafe(rows.doc_id) & (notices.version == rows.version)).select(
        notices.doc_id.alias("d"), notices.version.alias("v"), "notices", (F.col("n") / F.col("copies")).cast("long").alias("n"))
    texts = (d.select("doc_id", "version", digest(F.col("text"), True).alias("digest"))
             .join(digests(True), "digest", "left"))
    return (texts.join(per, texts.doc_id.eqNullSafe(per.d) & (texts.version == per.v), "left")
            .select("doc_id", F.col("digest").alias("text_sha256"), "licence",
                    F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n_notice_lines")))
