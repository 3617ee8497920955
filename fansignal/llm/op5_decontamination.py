"""Benchmark decontamination by a prefix-filtered join, DataFrame functions only.

Words are runs of letters a-z (A-Z lower-cased), digits and non-ASCII characters. A window
is ``width`` consecutive words of an item, or the whole item if it has fewer. A document
word inside any occurrence of any window is hit.

1. A window's shingles (three words, or all words of a window of fewer) are ordered by how
   often they occur in all documents. To hold the window a document must hold all of its
   shingles, so its necessary prefix is its rarest one; a window with a shingle that
   occurs nowhere is dropped at once.
2. Only these rarest shingles are joined with the documents' shingles. The place of the
   shingle in the window gives the start of the one possible occurrence (positional
   bound), and start and end must lie inside the document (length bound).
3. The words from start on are compared with the window's words.
4. Covered words are counted as the union of the occurrences of a document.

Benchmark tables of up to SMALL rows are sent to every task, larger ones are joined by
shuffles. Nulls and empties: null text has no words; an item without words has no window;
a null item_id hits words but is not listed. Items that repeat an id count once. Each
input row gives one row; rows that repeat a doc_id are looked at each for themselves.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fansignal.functions.common import let
from fansignal.sources.tables import staged

SHINGLE = 3
SMALL = 1_000_000  # rows of a few dozen bytes sent to every task at most
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, NOT_WORD), "")


def _shingles(w: Column, q: int) -> Column:
    """Hash of the q words from each position on (incomplete ones at the end match nothing)."""
    return F.transform(w, lambda x, i: F.xxhash64(F.lit(q), x, *[F.get(w, i + j) for j in range(1, q)]))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table whose size has been counted, else leave it to a shuffle join."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _doc_shingles(docs: DataFrame, q: int) -> DataFrame:
    return docs.select("doc_id", "version", F.posexplode(let(words(F.col("text")), lambda w: _shingles(w, q)))
                       .alias("at", "shingle"))


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """(item_id, window): distinct windows of items, as words joined by a space."""
    def cut(w):
        n = F.size(w)
        size = F.least(n, F.lit(width))
        starts = F.when(n > 0, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.array_join(F.slice(w, s, size), " "))
    return items.select("item_id", F.explode(let(words(F.col("text")), cut)).alias("window")).distinct()


def contaminated_words(documents: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, version) per
    row; version is the hash that tells rows of one doc_id apart."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("version", F.xxhash64("text"))
    item_windows = staged(windows_of(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")),
                                     width), "item-windows")
    parts = F.split("window", " ")
    windows = item_windows.select("window").distinct().withColumn("w", F.size(parts))
    windows = staged(windows.withColumn("q", F.least("w", F.lit(SHINGLE))), "windows")
    found = []
    for q in [r.q for r in windows.select("q").distinct().collect()]:     # at most SHINGLE values
        inside = F.transform(F.sequence(F.lit(1), F.col("w") - q + 1),
                             lambda s: F.xxhash64(F.lit(q), *[F.get(parts, s + (j - 1)) for j in range(q)]))
        sh = staged(windows.filter(F.col("q") == q).select("window", "w", F.posexplode(inside).alias("offset", "shingle")),
                    "window-shingles")
        small = sh.select("shingle").distinct()
        if small.count() <= SMALL:
            often = _doc_shingles(docs, q).join(F.broadcast(small), "shingle").groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
        else:
            often = _doc_shingles(docs, q).groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).join(small, "shingle")
        rank = F.struct(F.coalesce("often", F.lit(0)).alias("often"), "shingle", "offset")
        prefix = (sh.join(often, "shingle", "left").groupBy("window", "w").agg(F.min(rank).alias("rarest"))
                  .filter("rarest.often > 0").select("window", "w", "rarest.shingle", "rarest.offset"))
        prefix = staged(prefix, "prefixes")
        found.append(_doc_shingles(docs, q).join(_small(prefix), "shingle").filter(F.col("at") >= F.col("offset"))
                     .select("doc_id", "version", (F.col("at") - F.col("offset")).alias("start"), "w", "window"))
    if not found:
        empty = windows.filter(F.lit(False))
        found = [empty.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("version"),
                              F.lit(0).alias("start"), "w", "window")]
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    candidates = staged(candidates.distinct(), "candidates")

    keys = candidates.select("doc_id", "version").distinct()
    hit_docs = _same(docs, _small(keys.select(F.col("doc_id").alias("d"), F.col("version").alias("v"))), "left_semi")
    texts = hit_docs.dropDuplicates(["doc_id", "version"]).select("doc_id", "version", words(F.col("text")).alias("words"))
    c = candidates.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "start", "w", "window")
    there = F.array_join(F.slice("words", F.col("start") + 1, F.col("w")), " ")
    hits = staged(_same(texts, c, "inner").filter((F.col("start") + F.col("w") <= F.size("words")) & (there == F.col("window")))
                  .select("doc_id", "version", "start", "w", "window"), "occurrences")

    spans = hits.select("doc_id", "version", "start", (F.col("start") + F.col("w")).alias("end")).distinct()
    before = Window.partitionBy("doc_id", "version").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = (spans.withColumn("fresh", fresh).groupBy("doc_id", "version").agg(F.sum("fresh").alias("n_hit"))
               .select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "n_hit"))
    listed = (hits.select("doc_id", "version", "window").distinct().join(item_windows.filter("item_id is not null"), "window")
              .groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
              .select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "item_ids"))
    base = docs.select("doc_id", "version",
                       F.coalesce(F.regexp_count("text", F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = _same(_same(base, covered, "left").drop("d", "v"), listed, "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), ids.alias("item_ids"), "version")


def without_contaminated(documents: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """Rows of ``documents`` that no benchmark window occurs in, with all their columns."""
    marked = contaminated_words(documents, benchmark, width, id_col, text_col).filter("contaminated")
    bad = _small(staged(marked.select(F.col("doc_id").alias("d"), F.col("version").alias("v")).distinct(), "contaminated"))
    version = F.xxhash64(documents[text_col].cast("string"))
    return documents.join(bad, documents[id_col].cast("long").eqNullSafe(bad.d) & (version == bad.v), "left_anti")


def _same(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join a document table with one keyed by (d, v) = (doc_id, version); null ids match."""
    return docs.join(other, docs.doc_id.eqNullSafe(other.d) & (docs.version == other.v), how)
