"""MinHash near-deduplication by fast similarity sketching.

1. A document's set holds the hashes of its distinct k-word shingles. Its sketch has T
   coordinates filled in rounds: in round i every element is thrown into one bin by a
   fresh hash and each bin keeps the smallest (round, value); from round T on, bin i - T
   takes an element in any case. So every coordinate is filled after at most 2 T rounds,
   for any set size, and agreement of two sketches concentrates around their Jaccard
   similarity.
2. Identical sets are one class (its smallest document stands for it), so copies make no
   pairs. Coordinates are banded; classes that share a band key are in one bucket.
3. Each class is checked against the smallest class of all its buckets, then against the
   smallest class of each bucket that is still in another component; a bucket of m classes
   gives at most m - 1 pairs. One bit per coordinate drops pairs far below the threshold,
   then the full shingle sets decide.
4. Links give components. Only buckets that still hold several components are looked at
   again: members outside the bucket's largest component are compared with all members of
   other components, first by a finer sketch. A pair that shares several buckets comes from
   the one with the smallest key alone: all buckets it shares hold both components, so all
   of them are open. So no link between different components is lost, and a large group of
   near copies is never expanded into all its pairs.

Nulls and empties: a null or empty text has no shingles and links with nothing; a row with a null
id links with nothing, has no component and is kept. Rows that repeat an id are one document
node: if their sets differ, the node links their classes (a row without shingles stands for itself). Each input row gives one result row. A very
long text is one set of its shingles, held by one task. An empty table gives no rows. Only the
id and text columns are read.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fansignal.llm.graph import connected_components
from fansignal.llm.words import U64, WordHash, mix64, odd_multipliers, shingle_hashes, word_list
from fansignal.sources.tables import staged

T = 512          # coordinates of a sketch; one bit of each is kept
BANDED = 384     # coordinates used for bands
MAX_MISS = 1e-6  # allowed probability that a pair at the threshold shares no band
T_FINE = 4096    # coordinates (one bit each) of the sketches that decide between components
SEEDS = odd_multipliers(2 * T_FINE, 1234)


def sketch(h: np.ndarray, t: int = T) -> np.ndarray:
    """t coordinates (round << 33 | value) of a non-empty set of 64-bit hashes."""
    full, low = np.iinfo(np.uint64).max, U64((1 << 33) - 1)
    out = np.full(t, full, U64)
    step, i = max(1, min(2 * t, math.ceil(t * (math.log(t) + 3) / len(h)))), 0
    while i < 2 * t:
        j = min(2 * t, i + step)
        x = mix64(h[None, :] ^ SEEDS[i:j, None])
        rounds = np.arange(i, j, dtype=U64)[:, None]
        bins = ((x >> U64(33)) * U64(t)) >> U64(31)
        bins = np.where(rounds < U64(t), bins, rounds - U64(t)).astype(np.int64)
        np.minimum.at(out, bins.ravel(), ((rounds << U64(33)) | (x & low)).ravel())
        if not (out == full).any():
            break
        i = j
    return out


def band_rows(threshold: float) -> int:
    """Largest number of rows a band that misses a pair at the threshold with at most MAX_MISS."""
    return max(r for r in range(1, 17) if r == 1 or (1 - threshold ** r) ** (BANDED // r) <= MAX_MISS)


def least_agreement(threshold: float, t: int) -> int:
    """Bits out of t that a pair at the threshold shares but for five standard deviations."""
    p = (1 + threshold) / 2
    return math.floor(t * p - 5.2 * math.sqrt(t * p * (1 - p)))


def _bits(s: np.ndarray) -> np.ndarray:
    return np.packbits((mix64(s) & U64(1)).astype(np.uint8)).view(np.int64)


def _sketches(k: int, rows: int):
    bands = BANDED // rows

    def run(batches):
        cache, mul = WordHash(), odd_multipliers(rows, 99)
        band_no = odd_multipliers(bands, 4321)
        for batch in batches:
            n, key, keys, bits = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                h = np.unique(shingle_hashes(cache.of(word_list(text)), k))
                n.append(len(h))
                if len(h):
                    s = sketch(h)
                    key.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    keys.append(mix64((s[:bands * rows].reshape(bands, rows) * mul).sum(1, dtype=U64) ^ band_no).view(np.int64))
                    bits.append(_bits(s))
                else:
                    key.append(None)
                    keys.append(np.zeros(0, np.int64))
                    bits.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), _lists(keys), _lists(bits)],
                ["doc_id", "n_shingles", "set_key", "bands", "bits"])
    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _sets(k: int):
    def run(batches):
        cache = WordHash()
        for batch in batches:
            sets = [np.unique(shingle_hashes(cache.of(word_list(t)), k)).view(np.int64)
                    for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], ["rep", "shingles"])
    return run


def _fine(batches):
    """Fine sketches of sets that are at hand; the keys of the open buckets pass through."""
    for batch in batches:
        bits = [_bits(sketch(np.array(x.as_py(), np.int64).view(U64), T_FINE)) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(bits), batch.column(2)], ["rep", "bits", "keys"])


def _agreeing(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose sketch bits agree in at least ``least`` places."""
    def side(name):
        return reps.select(F.col("rep").alias(name), F.col("bits").alias(f"{name}_bits"), F.col("n").alias(f"{name}_n"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter(_agreement("a_bits", "b_bits", T) >= least).select("a", "b"))


def _agreement(x: str, y: str, t: int):
    return t - sum(F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(t // 64))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 |A & B| >= percent |A | B| on the full sets."""
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(b, "b").join(a, "a")
            .select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), shared.alias("shared"))
            .filter(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b"))


def _between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    for end in ("a", "b"):
        pairs = (pairs.join(comp.select(F.col("node").alias(end), F.col("component").alias("c")), end, "left")
                 .withColumn(f"c{end}", F.coalesce("c", end)).drop("c"))
    return pairs.filter("ca <> cb")


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after adding links."""
    if links.isEmpty():
        return comp
    return connected_components(comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
                                .unionByName(links), "a", "b")


def _of_repeated_ids(sigs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the classes of ids whose rows have different sets."""
    rows = sigs.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "set_key")
    several = rows.groupBy("doc_id").agg(F.min("set_key").alias("one"), F.max("set_key").alias("other")).filter("one <> other")
    held = rows.join(several.select("doc_id"), "doc_id", "left_semi").join(reps.select("set_key", "rep"), "set_key")
    first = held.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return held.join(first, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id) per row of ``documents``.

    Links documents with 100 * intersection >= percent * union of their k-word shingle
    sets. class_id: smallest document with the identical set; component_id: smallest
    document reachable by links."""
    rows = band_rows(percent / 100)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>, bits array<long>"
    sigs = staged(texts.mapInArrow(_sketches(k, rows), schema), "sketches")
    reps = staged(sigs.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key")
                  .agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"),
                       F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits")), "classes")
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last")
    bucketed = staged(keyed.join(hubs.select("key", "hub"), "key"), "buckets")

    active = bucketed.select("rep").distinct()
    firsts = texts.join(active.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    sets = staged(firsts.mapInArrow(_sets(k), "rep long, shingles array<long>"), "sets")

    least, least_fine = least_agreement(percent / 100, T), least_agreement(percent / 100, T_FINE)
    pairs = staged(bucketed.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(),
                   "hub-pairs")
    first = pairs.groupBy("b").agg(F.min("a").alias("a"))
    links = staged(_confirmed(_agreeing(first, reps, least), sets, percent), "links")
    comp = connected_components(links, "a", "b")
    rest = _between(pairs, comp).select("a", "b")
    comp = _joined(comp, staged(_confirmed(_agreeing(rest, reps, least), sets, percent), "hub-links"))

    placed = staged(bucketed.select("key", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
                    .withColumn("component", F.coalesce("component", "rep")), "placed")
    per = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    mixed = (per.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.count(F.lit(1)).alias("parts"))
             .filter("parts > 1").select("key", F.col("top.component").alias("largest")))
    open_rows = staged(placed.join(mixed, "key"), "open")
    keys = open_rows.groupBy("rep").agg(F.collect_set("key").alias("keys"))   # one key per band at most
    fine = staged(sets.join(keys, "rep").select("rep", "shingles", "keys").mapInArrow(
        _fine, "rep long, bits array<long>, keys array<long>"), "fine-sketches")
    open_rows = open_rows.join(fine, "rep")
    x = open_rows.filter("component <> largest").select(
        "key", "largest", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("bits").alias("ba"), F.col("keys").alias("ka"))
    y = open_rows.select("key", F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("bits").alias("bb"),
                         F.col("keys").alias("kb"))
    once = (F.array_min(F.array_intersect("ka", "kb")) == x.key) & ((F.col("cb") == F.col("largest")) | (F.col("a") < F.col("b")))
    cross = (x.join(y, (x.key == y.key) & (F.col("ca") != F.col("cb")) & (_agreement("ba", "bb", T_FINE) >= least_fine) & once)
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    comp = _joined(comp, staged(_confirmed(cross, sets, percent), "cross-links"))
    comp = _joined(comp, staged(_of_repeated_ids(sigs, reps), "id-links"))
    final = (reps.select("set_key", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
             .select("set_key", "rep", F.coalesce("component", "rep").alias("component_id")))
    known = F.col("doc_id").isNotNull()
    component = F.when(known, F.coalesce("component_id", "doc_id"))
    return (sigs.select("doc_id", "n_shingles", "set_key").join(final, "set_key", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
                    F.when(known, F.coalesce("rep", "doc_id")).alias("class_id")))
