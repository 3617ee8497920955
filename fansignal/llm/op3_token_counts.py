"""Token counts with a whole-token shortcut (byte-fallback piece models).

Which vocabulary strings stand for one token is proved once, offline, from the vocabulary
itself: every piece is encoded by the library, and those that come back as one token form
the table of whole tokens. The vocabulary also proves where merges never reach: no piece
holds a space mark after another character, and a new line is in no piece of several
characters. So a text may be cut at new lines (one token each) and before every space mark
that follows another character; its count is the sum over these pre-tokens.

A pre-token found in the table counts 1 at once; the others are merged by the library,
each distinct one once while a task remembers it, many at a time between new lines. If a
model breaks one of these properties or changes texts before it merges, whole texts go
through the library.

A null text counts as empty. Each row gives one row; ids are carried through unchanged.
"""
from __future__ import annotations

import re
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\u2581"
SLICE_CHARS = 4_000_000   # text split at a time


class PieceCounter:
    """Counts tokens of whole texts as the library's encode() would give them."""

    def __init__(self, model_file: str, remember: int = 400_000):
        import sentencepiece
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.remember = remember
        plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
                 if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.line = sp.encode("\n")[-1]
        self.splits = self._cuts_are_safe(plain)
        self.whole: dict[str, int] = {}
        if self.splits:
            self.whole = {p: 1 for p, n in zip(plain, self._merge(plain), strict=True) if n == 1}
        self.known = dict(self.whole)

    def _cuts_are_safe(self, plain: list[str]) -> bool:
        probe = "  a  b \ufb01 \u00bd \uff21 \u00e9 "   # a model that normalises changes one of these
        sp = self.sp
        return (sp.decode(sp.encode(probe)) == probe and sp.encode("a", out_type=str)[0].startswith(MARK)
                and not any("\n" in p and len(p) > 1 or re.search(f"[^{MARK}]{MARK}", p) for p in plain))

    def _merge(self, units: list[str]) -> list[int]:
        """Tokens of each pre-token (without new lines), merged by the library."""
        ids = np.array(self.sp.encode("\n" + "\n".join(units).replace(MARK, " ") + "\n"))
        return (np.diff(np.flatnonzero(ids == self.line)) - 1).tolist()

    @staticmethod
    def _pre_tokens(text: str) -> list[str]:
        """Pre-tokens of a text without its new lines; a space mark stands before the text."""
        out: list[str] = []
        for line in (" " + text).replace(MARK, " ").split("\n"):
            first, *parts = line.split(" ")
            if first:
                out.append(first)
            if "" not in parts:
                out += [MARK + p for p in parts]
                continue
            marks = ""
            for p in parts:
                marks += MARK
                if p:
                    out.append(marks + p)
                    marks = ""
            if marks:
                out.append(marks)
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        if not self.splits:
            return [len(self.sp.encode(t)) if t else 0 for t in texts]
        out: list[int] = []
        part: list[str] = []
        size = 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size >= SLICE_CHARS:
                out += self._slice(part)
                part, size = [], 0
        return out + self._slice(part)

    def _slice(self, texts: list[str]) -> list[int]:
        if len(self.known) > self.remember:
            self.known = dict(self.whole)
        known = self.known
        words = [self._pre_tokens(t) if t else [] for t in texts]
        new = {w for ws in words for w in ws if w not in known}
        for units in batched(new, 5000):
            known.update(zip(units, self._merge(list(units)), strict=True))
        return [sum(map(known.__getitem__, ws)) + t.count("\n") for ws, t in zip(words, texts, strict=True)]


def _counts(model_file: str, limit: int):
    def run(batches):
        counter = PieceCounter(model_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = counter.counts(texts)
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def token_counts(documents: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each whole text; model_file must be
    readable on every executor (it is part of an installed package)."""
    d = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_counts(model_file, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
