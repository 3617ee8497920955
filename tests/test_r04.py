"""Disk and time of queries over tables several times as large: what a review found to go beyond the limits."""
import os
import random
from collections import Counter

from pyspark.sql import functions as F

from fansignal.llm.op6_passages import repeated_passages
from fansignal.operators import dedup as dd
from fansignal.operators import enrich as en
from fansignal.session import shared_dir


def _staged(spark):
    at = f"{shared_dir(spark)}/staged".removeprefix("file://")
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_passages_drop_the_tables_no_later_step_reads(spark):
    """op6: seeds and what comes of them go as soon as the pairs are known."""
    words = [f"w{i * i % 997}x{i}" for i in range(400)]
    rows = [(i, " ".join([*words[i * 20:i * 20 + 80], f"end{i}"])) for i in range(12)] + [(90, " ".join(words[:80])), (91, " ".join(words[:80]))]
    before = _staged(spark)
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {name.rpartition("-")[0].split("-")[0] for name in _staged(spark) - before}
    assert left == {"pairs"}
    assert {(91, 90), (1, 0)} <= {(r.doc_id, r.other_id) for r in got.collect()}


def _edited(seed, size=300):
    """Texts of one to 80 words, many of them copies of earlier ones with some words changed."""
    r, texts = random.Random(seed), []
    for i in range(size):
        w = list(r.choice(texts[-20:])) if texts and r.random() < 0.7 else [f"w{r.randrange(400)}" for _ in range(r.randrange(1, 80))]
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"n{i}"
        texts.append(w)
    return [" ".join(w) for w in texts]


def _sets_by_hand(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append(frozenset(tuple(w[j:j + 3]) for j in range(len(w) - 2)) if len(w) >= 3 else frozenset(w))
    return out


def test_shared_shingles_are_counted_without_storing_the_hashes(spark):
    """e05, e03, e06, f05: only the number of shingles that other posts hold is stored of every post."""
    texts = [*_edited(1), "", None, "alone here now"]
    posts = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("ts", F.col("id")).repartition(5)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        sets = dd.shingle_sets(posts)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert "h" not in sets.columns
    by_hand = _sets_by_hand(texts)
    held = Counter(x for s in by_hand for x in s)
    want = {i: (len(s), sum(held[x] > 1 for x in s)) for i, s in enumerate(by_hand)}
    assert {r.id: (r.n, r.shared) for r in sets.collect()} == want


def test_keep_first_of_edited_copies(spark):
    """e05: as by hand, whatever is left out on the way."""
    texts = [*_edited(2), "", None, "two words", "two words"]
    posts = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ts", F.lit(1) - F.col("doc_id") % 7)
    sets = _sets_by_hand(texts)
    order = sorted(range(len(texts)), key=lambda i: (1 - i % 7, i))
    at = {i: p for p, i in enumerate(order)}
    want = [i for i, s in enumerate(sets) if not any(at[j] < at[i] and s and len(s & x) / len(s | x) >= 0.8 for j, x in enumerate(sets))]
    assert sorted(r.doc_id for r in dd.keep_first(posts).collect()) == want and len(want) < 250


def test_near_copies_meet_in_tiles(spark):
    """e03: sets in another order that share most shingles share a min-hash, and tiles tell the same pairs as all pairs do."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(60):
        w = list(base)
        w[r.randrange(150)] = f"n{i}"
        texts.append(" ".join(w[r.randrange(9):]))
    sets = _sets_by_hand(texts)
    posts = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ts", F.lit(5))
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(60) for i in range(j)}
    want = {k: x for k, x in want.items() if x >= 0.8 and sets[k[0]] != sets[k[1]]}
    before = _staged(spark)
    got = {(p.earlier_id, p.later_id): p.jaccard for p in dd.near_duplicate_pairs(posts).collect()}
    assert got == want
    new = [x for x in _staged(spark) - before if x.startswith("similar-sets")]
    in_tiles = spark.read.parquet(*[f"{shared_dir(spark)}/staged/{x}" for x in new]).count()
    assert in_tiles > 0.95 * len(want)


def test_preprocess_keeps_no_hashes_while_texts_travel(spark):
    """f05, e06: what is stored of all posts beside their texts goes before the texts travel, or holds no hashes."""
    posts = spark.createDataFrame([(i, t, "fan", "web") for i, t in enumerate(_edited(5))], "post_id long, text string, author string, source string")
    posts = posts.withColumn("timestamp", F.timestamp_seconds("post_id"))
    before = _staged(spark)
    en.preprocess(posts, F.lit("2026-06-11").cast("timestamp"))
    first = {x.rpartition("-")[0] for x in _staged(spark) - before}
    assert {"cleaned", "kept"} <= first and "shingle-sets" not in first and "first-sets" not in first
    before = _staged(spark)
    dd.rolling_dedup(posts, ["source"], ["timestamp", "post_id"])
    new = [x for x in _staged(spark) - before if x.startswith("shingle-sets")]
    assert new and "h" not in spark.read.parquet(*[f"{shared_dir(spark)}/staged/{x}" for x in new]).columns
