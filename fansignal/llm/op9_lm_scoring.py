"""Language-model scores by prediction by partial matching (PPM) over bytes.

A text is scored as its token sequence: lower-cased (A-Z) words joined by one space, ended
by a new line, which is in no word; ORDER new lines before the start serve as context. The
model is a byte-context trie of depth ORDER, pretrained on all training documents. In a
context, longest first, a symbol seen there gets n / (T + D), else an escape D / (T + D) goes
down to the next shorter context (method C). Symbols of the longer context are excluded on
the way down: every symbol seen after a context was also seen after its suffix, so T and D
just lose the sums over the longer context's symbols. Below order 0, the symbols never
seen share the rest evenly. Contexts never seen cost nothing.

The code length of a position depends only on its gram (ORDER bytes of context and the
symbol), so it is computed once for each distinct gram. Documents are dealt to chunks of bounded size by a hash.

1. Each chunk sends its distinct words and grams with their training counts, in blocks,
   to the range of word hashes or the pair of context bytes they belong to.
2. Each range adds up the counts of all chunks (the whole corpus), or walks the trie of its
   contexts, and sends every chunk the numbers it asked for, in the chunk's order.
3. Each chunk scores its documents.

Nothing is broadcast but the 256 x 256 counts of byte pairs. Words meet as 64-bit hashes.

Null or empty text: the end token only. A null doc_id is a training document. Rows that
repeat a doc_id are documents of their own. Each input row gives one row.
"""
from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fansignal.llm.words import U64, word_list
from fansignal.sources.tables import staged

CHUNK_BYTES = 11_000_000
SLICE_BYTES = 2_000_000       # of a chunk, worked on at a time
ORDER = 5                     # context bytes; a gram is one number, nearest context byte on top
END = b"\n"                   # ends a text and stands before its start
SYMBOLS = 256 - 5 + 1         # bytes that words and spaces can hold, and the end
WORDS, GRAMS, PAIRS = 0, 1, 2
BLOCK = "kind int, bucket int, chunk int, keys binary, train binary, n long"
ANSWER = "chunk int, kind int, bucket int, numbers binary, n long, v long"


class Chunk:
    """Documents of a chunk as token sequences."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id")
        self.held = np.array(table.column("held_out").to_pylist(), bool)
        self.bodies = [END * ORDER + b" ".join(word_list(t.as_py())) + END for t in table.column("text").cast(pa.binary())]

    def word_keys(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(distinct words, their hashes, their training counts)."""
        train: Counter = Counter()
        every: set = set()
        for b, held in zip(self.bodies, self.held, strict=True):
            (every if held else train).update(b.split())
        distinct = list(every.union(train))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), U64, len(distinct))
        return distinct, hashes, np.fromiter((train[w] for w in distinct), np.int64, len(distinct))

    def grams(self):
        """(grams, grams per document, held-out flags) slice by slice, in document order."""
        at, n = 0, len(self.bodies)
        while at < n:
            to, size = at, 0
            while to < n and size < SLICE_BYTES:
                size += len(self.bodies[to])
                to += 1
            sizes = np.array([len(b) for b in self.bodies[at:to]])
            data = np.frombuffer(b"".join(self.bodies[at:to]), np.uint8)
            m = len(data) - ORDER
            gram = data[ORDER:].astype(U64)
            for back in range(1, ORDER + 1):
                gram |= data[ORDER - back:ORDER - back + m].astype(U64) << U64(8 * (ORDER + 1 - back))
            real = np.ones(len(data), bool)
            starts = np.cumsum(sizes) - sizes
            for i in range(ORDER):
                real[starts + i] = False
            yield gram[real[ORDER:]], sizes - ORDER, self.held[at:to]
            at = to


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]):
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(at, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)


def _blocks(kind: int, chunk: int, keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray):
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]]), strict=True):
        if hi > lo:
            yield (kind, int(bucket[lo]), chunk, keys[lo:hi].tobytes(), counts[lo:hi].astype("<u4").tobytes(), None)


def _merged_words(hashes: np.ndarray, counts: np.ndarray):
    keys, at = np.unique(hashes, return_inverse=True)
    return keys, np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64), at


def _ask(bits: int):
    def run(table: pa.Table) -> pa.Table:
        no = table.column("chunk")[0].as_py()
        c = Chunk(table)
        _, hashes, counts = c.word_keys()
        keys, counts, _ = _merged_words(hashes, counts)
        rows = list(_blocks(WORDS, no, keys, counts, (keys >> U64(64 - bits)).astype(np.int64)))
        distinct, many, pairs = [], [], np.zeros(1 << 16, np.int64)
        for gram, per_doc, held in c.grams():
            train = gram[~np.repeat(held, per_doc)]
            for part, counted in ((train, True), (gram[np.repeat(held, per_doc)], False)):
                u, n = np.unique(part, return_counts=True)
                distinct.append(u)
                many.append(n if counted else np.zeros_like(n))
            last = ((train >> U64(8 * ORDER)) << U64(8)) | (train & U64(255))
            pairs += np.bincount(last.astype(np.int64), minlength=1 << 16)
        grams, n = _summed(distinct, many)
        rows += _blocks(GRAMS, no, grams, n, (grams >> U64(8 * ORDER - 8)).astype(np.int64))
        rows += [(PAIRS, int(p), no, None, None, int(pairs[p])) for p in np.flatnonzero(pairs)]
        return _table(rows, ["kind", "bucket", "chunk", "keys", "train", "n"],
                      [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()])
    return run


def _table(rows: list[tuple], names: list[str], types: list) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({k: pa.array(list(c), t) for k, c, t in zip(names, cols, types, strict=True)})


ANSWER_NAMES = ["chunk", "kind", "bucket", "numbers", "n", "v"]
ANSWER_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]


def _read_blocks(table: pa.Table):
    chunks = table.column("chunk").to_pylist()
    keys = [np.frombuffer(x.as_py(), U64) for x in table.column("keys")]
    train = [np.frombuffer(x.as_py(), "<u4") for x in table.column("train")]
    return chunks, keys, train


def _count_words(table: pa.Table) -> pa.Table:
    """Training counts of one range of word hashes over all chunks."""
    bucket = table.column("bucket")[0].as_py()
    chunks, keys, train = _read_blocks(table)
    _, total, at = _merged_words(np.concatenate(keys), np.concatenate(train))
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    rows = [(c, WORDS, bucket, total[a].astype("<u8").tobytes(), None, None)
            for c, a in zip(chunks, np.split(at, cuts), strict=True)]
    rows.append((-1, WORDS, bucket, None, int(total.sum()), int((total > 0).sum())))
    return _table(rows, ANSWER_NAMES, ANSWER_TYPES)


def _sums(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights=x, minlength=n)


def gram_scores(keys: np.ndarray, train: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 P(symbol | context) of sorted distinct grams that share the two nearest bytes.

    train: training counts aligned with keys; pairs[b, s]: counts of s after byte b."""
    symbol = (keys & U64(255)).astype(np.int64)
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)

    def visit(n, total, kinds):
        """One context: n, total and kinds per key, after exclusion."""
        nonlocal open_
        both = np.where(kinds > 0, total + kinds, 1)
        hit = open_ & (kinds > 0) & (n > 0)
        out[hit] += np.log10(n[hit] / both[hit])
        open_ = open_ & ~hit
        esc = open_ & (kinds > 0)
        out[esc] += np.log10(kinds[esc] / both[esc])

    gone_total, gone_kinds = np.zeros(len(keys)), np.zeros(len(keys))   # what the longer context excludes
    entry, place, n = keys, np.arange(len(keys)), train.astype(float)   # distinct (context, symbol)
    for order in range(ORDER, 1, -1):
        context, of = np.unique(entry >> U64(8), return_inverse=True)
        total, kinds = _sums(of, n, len(context)), _sums(of, n > 0, len(context))
        visit(n[place], (total[of])[place] - gone_total, (kinds[of])[place] - gone_kinds)
        if order > 2:
            shorter, up = np.unique(((entry >> U64(16)) << U64(8)) | (entry & U64(255)), return_inverse=True)
            below = _sums(up, n, len(shorter))
        else:
            below, up = pairs[int(keys[0] >> U64(8 * ORDER))].astype(float), (entry & U64(255)).astype(np.int64)
        gone_total = _sums(of, (n > 0) * below[up], len(context))[of][place]
        gone_kinds = kinds[of][place]
        if order > 2:
            entry, place, n = shorter, up[place], below
    n1, n0 = below, pairs.sum(0)
    visit(n1[symbol], n1.sum() - gone_total, (n1 > 0).sum() - gone_kinds)
    rest = n0[n1 == 0]
    visit(n0[symbol], np.full(len(keys), rest.sum()), np.full(len(keys), (rest > 0).sum()))
    out[open_] -= math.log10(max(SYMBOLS - int((n0 > 0).sum()), 1))
    return out


def _score_grams(pairs: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        chunks, keys, train = _read_blocks(table)
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        score = gram_scores(every, _sums(at, np.concatenate(train), len(every)), pairs)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return _table([(c, GRAMS, bucket, score[a].astype("<f8").tobytes(), None, None)
                       for c, a in zip(chunks, np.split(at, cuts), strict=True)], ANSWER_NAMES, ANSWER_TYPES)
    return run


def _answers(table: pa.Table, kind: int, dtype) -> np.ndarray:
    rows = sorted((b, x) for k, b, x in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "numbers")), strict=True) if k == kind)
    return np.frombuffer(b"".join(x for _, x in rows), dtype)


def _score(total: int, kinds: int, ends: int):
    below = math.log10(total + kinds + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left)
        distinct, hashes, _ = c.word_keys()
        _, at = np.unique(hashes, return_inverse=True)
        value = np.log10(_answers(right, WORDS, "<u8")[at] + 1.0) if distinct else np.zeros(0)
        gain = dict(zip(distinct, value.tolist(), strict=True))
        n_tokens, known, base = [], [], []
        end_gain = math.log10(ends + 1)
        for b in c.bodies:
            w = b.split()
            x = np.fromiter(map(gain.__getitem__, w), float, len(w))
            n_tokens.append(len(w) + 1)
            known.append(int(np.count_nonzero(x)) + (ends > 0))
            base.append(float(x.sum()) + end_gain - below * (len(w) + 1))
        parts = [(*np.unique(gram, return_inverse=True), per_doc) for gram, per_doc, _ in c.grams()]
        parts = [(u, at.astype(np.int32), per_doc) for u, at, per_doc in parts]
        keys = np.unique(np.concatenate([u for u, _, _ in parts]))
        lengths = _answers(right, GRAMS, "<f8")
        score = np.concatenate([np.add.reduceat(lengths[np.searchsorted(keys, u)][at], np.cumsum(per_doc) - per_doc)
                                for u, at, per_doc in parts])
        return pa.table({"doc_id": c.ids, "held_out": pa.array(c.held), "n_tokens": pa.array(n_tokens, pa.int64()),
                         "n_known": pa.array(known, pa.int64()),
                         "train_tokens": pa.array([total] * len(base), pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})
    return run


def lm_scores(documents: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    held_out: Column that marks the documents not learnt from; by default those whose
    crc32 of doc_id as text leaves 2 modulo 7."""
    d = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                         *([] if held_out is None else [held_out.alias("held_out")]))
    if held_out is None:
        d = d.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    d = d.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    size, rows, held = d.agg(F.sum(F.octet_length("text")), F.count(F.lit(1)), F.count_if("held_out")).first()
    chunks = max(1, -(-((size or 0) + 100 * rows) // CHUNK_BYTES))
    bits = max(1, min(30, (2 * chunks - 1).bit_length()))
    dealt = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    asked = staged(dealt.groupBy("chunk").applyInArrow(_ask(bits), BLOCK), "asked")
    pairs = np.zeros(1 << 16, np.int64)
    for r in asked.filter(F.col("kind") == PAIRS).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        pairs[r.bucket] = r.n          # 65,536 numbers at most
    words = asked.filter(F.col("kind") == WORDS).groupBy("bucket").applyInArrow(_count_words, ANSWER)
    grams = asked.filter(F.col("kind") == GRAMS).groupBy("bucket").applyInArrow(_score_grams(pairs.reshape(256, 256)), ANSWER)
    answers = staged(words.unionByName(grams), "answers")
    total, kinds = answers.filter("chunk < 0").agg(F.sum("n"), F.sum("v")).first()
    ends = rows - held                 # every training document ends once
    schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")
    return (dealt.groupBy("chunk").cogroup(answers.filter("chunk >= 0").groupBy("chunk"))
            .applyInArrow(_score((total or 0) + ends, (kinds or 0) + (ends > 0), ends), schema))
