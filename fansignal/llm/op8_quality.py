"""Quality classifier from weak labels.

1. Overlapping heuristic labellers look at every text (share of symbols, capitals, bars,
   exclamations, words that repeat the word one or two before, marks) and vote bad,
   good or abstain.
2. A document enters the label model as its vote pattern only; patterns are counted over
   all documents (at most 3^6 of them) and expectation-maximisation estimates the share of
   bad documents and each labeller's accuracy, P(vote | bad) and P(vote | good).
3. The posteriors label a bounded sample (SAMPLE documents on average, chosen by a hash of
   id and text) on which a linear scorer over hashed character-shape 4-grams is trained as
   a logistic regression, each document once per class, weighted by its posterior.
4. The scorer rates every whole text; those below 0.5 are rejected.

Null texts and texts without words have nothing to keep: score 0, rejected. Each input row
gives one row; repeated rows get equal scores. quality_toxic is told apart from quality: the
share of English insult words (INSULTS) is over TOXIC. Insults in other languages are not known. If the posteriors leave one class empty, the
posterior of the vote pattern is the score. Columns named quality_score, quality_kept or
quality_toxic are replaced; all others pass unchanged.
"""
from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fansignal.llm.words import mix64, odd_multipliers
from fansignal.sources.tables import staged

SAMPLE = 8000
BUCKETS = 512
ABSTAIN, GOOD, BAD = 0, 1, 2
# (labeller, good below, bad above)
LABELLERS = [("symbols", 0.01, 0.05), ("capitals", 0.25, 0.6), ("bars", 0.02, 0.15), ("exclamations", 0.02, 0.15),
             ("repeats", 0.05, 0.25), ("marks", 0.12, 0.2)]
FALSE_ALARMS = 0.0002   # most that P(bad vote | good) may be: a labeller is built to be silent rather than wrong
TOXIC = 0.01
INSULTS = frozenset(b"""trash pathetic idiot idiots idiotic disgusting worthless stupid clown clowns loser losers scum moron
    morons moronic imbecile imbeciles dumbass dimwit halfwit cretin vermin filth lowlife scumbag jerk bastard bastards bitch
    asshole assholes cunt dickhead wanker twat retard retarded subhuman freak creep coward cowards""".split())
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
HIGH, SPACE = bytes(range(128, 256)), b" \t\n\r\x0b\x0c"


def measures(b: bytes, words: list[bytes]) -> list[float]:
    """The labellers' shares, in the order of LABELLERS (8 more letters keep words of one capital calm)."""
    n, size = max(1, len(words)), max(1, len(b) - sum(b.count(c) for c in SPACE))
    upper = len(b) - len(b.translate(None, UPPER))
    lower = len(b) - len(b.translate(None, LOWER))
    high = len(b) - len(b.translate(None, HIGH))
    digits = len(b) - len(b.translate(None, b"0123456789"))
    symbols = len(b) - len(b.translate(None, b"#$%&*"))
    again = max((sum(map(eq, words[lag:], words)) for lag in (1, 2)), default=0)
    return [symbols / size, upper / (upper + lower + 8), min(1.0, b.count(b"|") / n), min(1.0, b.count(b"!!") / n),
            again / n, (size - upper - lower - high - digits) / (size + 8)]


LETTERS = bytes(c if c in LOWER or c >= 128 else c + 32 if c in UPPER else 32 for c in range(256))


def toxic(b: bytes) -> bool:
    """Whether insults are more than TOXIC of the words."""
    w = b.translate(LETTERS).split()
    return not INSULTS.isdisjoint(w) and sum(x in INSULTS for x in w) > TOXIC * len(w)


def votes(m: list[float]) -> int:
    """Votes as digits of a base-3 number."""
    out = 0
    for x, (_, good, bad) in zip(m, LABELLERS, strict=True):
        out = 3 * out + (BAD if x > bad else GOOD if x < good else ABSTAIN)
    return out


def _shapes() -> np.ndarray:
    """Byte -> shape: letters by case, digits as one, non-ASCII as lower case, others themselves."""
    s = np.arange(256)
    s[97:123] = s[128:] = 1
    s[65:91] = 2
    s[48:58] = 3
    return s.astype(np.uint64)


SHAPE = _shapes()
PLACE = odd_multipliers(4, 2024)


def hashed(b: bytes, m: list[float]) -> np.ndarray:
    """Square roots of hashed shape 4-gram shares, then the labellers' shares."""
    s = SHAPE[np.frombuffer(b.ljust(4), np.uint8)]
    n = len(s) - 3
    h = sum(s[i:i + n] * PLACE[i] for i in range(4))
    share = np.bincount((mix64(h) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) / (n + 20)   # little text, little said
    return np.concatenate([np.sqrt(share), m])


def _texts(batch: pa.RecordBatch, name: str):
    for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()):
        b = t.as_py() or b""
        yield b, b.split()


def _patterns(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([votes(measures(b, w)) if w else -1 for b, w in _texts(batch, "text")], pa.int32())], ["pattern"])


def _examples(posterior: dict[int, float]):
    def run(batches):
        for batch in batches:
            x, p = [], []
            for b, w in _texts(batch, "text"):
                if w:
                    m = measures(b, w)
                    x.append(hashed(b, m).tolist())
                    p.append(posterior[votes(m)])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(p, pa.float64())], ["x", "p_good"])
    return run


def label_model(counts: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], float, np.ndarray]:
    """EM over vote patterns: (P(good) by pattern, share of good, P(vote | class)).

    The table has one row per labeller, one column per vote, for bad and for good."""
    k = len(LABELLERS)
    patterns = np.array(sorted(counts), int)
    n = np.array([counts[p] for p in patterns], float)
    v = (patterns[:, None] // 3 ** np.arange(k - 1, -1, -1)) % 3
    table = np.empty((2, k, 3))
    table[0] = [0.2, 0.4, 0.4]     # bad documents: any labeller may miss them
    table[1] = [0.2, 0.798, FALSE_ALARMS]
    prior, good = 0.8, np.zeros(len(n))
    for _ in range(rounds):
        log = np.log(table[:, np.arange(k)[None, :], v]).sum(2) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done, good = np.abs(new - good).max(initial=0) < 1e-9, new
        if done:
            break
        for c, w in ((0, n * (1 - good)), (1, n * good)):
            for j in range(k):
                table[c, j] = np.bincount(v[:, j], weights=w, minlength=3) + [1, 1, 0.1 if c else 1]
            table[c] /= table[c].sum(1, keepdims=True)
        table[1, :, BAD] = np.minimum(table[1, :, BAD], FALSE_ALARMS)
        prior = float(np.clip((n * good).sum() / n.sum(), 0.01, 0.99))
    return dict(zip(patterns.tolist(), good.tolist(), strict=True)), prior, table


def fit(documents: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id"):
    """(posterior by vote pattern, weights or None, intercept) learnt from all documents."""
    d = documents.select(F.col(text_col).cast("string").alias("text"),
                         F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    counts = {r.pattern: r.n for r in d.select("text").mapInArrow(_patterns, "pattern int").filter("pattern >= 0")
              .groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}      # at most 3^6 rows
    if not counts:
        return {}, None, 0.0
    posterior, _, _ = label_model(counts)
    share = min(1.0, sample / sum(counts.values()))
    chosen = d.filter(F.pmod("h", F.lit(1_000_003)) < int(share * 1_000_003) + 1).select("text")
    rows = staged(chosen.mapInArrow(_examples(posterior), "x array<double>, p_good double"), "examples")
    both = (rows.select("x", F.lit(1.0).alias("label"), F.col("p_good").alias("weight"))
            .unionByName(rows.select("x", F.lit(0.0).alias("label"), (1 - F.col("p_good")).alias("weight")))
            .filter("weight > 0.001"))
    if both.select("label").distinct().count() < 2:
        return posterior, None, 0.0
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    lr = LogisticRegression(maxIter=40, regParam=1e-4, weightCol="weight")
    model = lr.fit(both.select(array_to_vector("x").alias("features"), "label", "weight"))
    return posterior, np.array(model.coefficients.toArray()), float(model.intercept)


def _score(model, text_col: str, names: list[str]):
    posterior, weights, intercept = model

    def one(b: bytes, w: list[bytes]) -> float:
        if not w:
            return 0.0
        m = measures(b, w)
        if weights is None:
            return posterior.get(votes(m), 1.0)
        return float(1 / (1 + np.exp(-np.clip(hashed(b, m) @ weights + intercept, -500, 500))))

    def run(batches):
        for batch in batches:
            texts = list(_texts(batch, text_col))
            s = [one(b, w) for b, w in texts]
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64()), pa.array([x >= 0.5 for x in s], pa.bool_()),
                                              pa.array([toxic(b) for b, _ in texts], pa.bool_())],
                                             [*names, "quality_score", "quality_kept", "quality_toxic"])
    return run


def quality(documents: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``documents`` with quality_score (0 to 1), quality_kept and quality_toxic."""
    model = fit(documents, sample, text_col, id_col)
    names = [c for c in documents.columns if c not in ("quality_score", "quality_kept", "quality_toxic")]
    schema = T.StructType([documents.schema[c] for c in names]).add("quality_score", "double").add("quality_kept", "boolean")
    schema = schema.add("quality_toxic", "boolean")
    return documents.select(*names).mapInArrow(_score(model, text_col, names), schema)
