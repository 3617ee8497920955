"""Repair of conversation structure: the cheapest edits that make the roles alternate.

Turns of a conversation, by turn (nulls first; rows of one turn by role and text), are kept
(0), given the role user or assistant (1), deleted (2) or preceded by an inserted empty turn
(5) so that the initials of the roles read ``(s?(ua)+)?``. Blank and repeated turns must be
deleted; a truncated turn that is not deleted costs 5 more. Of equally cheap edits the one
whose initials D, I, K, R are least in ASCII order is taken.

Rows are dealt by conversation once. Every row goes through the stream twice: first from the
last turn to the first without its text, then from the first to the last with it. On the
way back a state holds what the rest of the conversation costs from each of four places in
the pattern, carried from one Arrow batch to the next; the best edit from each place is kept
in one byte a turn (four times two bits), and full blocks of these bytes are packed and
spilled to the shared folder. Written back to front, each choice is final and ties need no
texts. On the way forth the bytes are read in reverse, edits are applied, and the hash of
the repaired conversation is fed turn by turn. So memory is bounded by a batch, a block, and the
audit string of one conversation, whatever its length; a conversation's hash needs its turns in
order, hence one task per conversation.

Null texts, roles and turns count as one space (a blank turn; a role that is never right; a
turn before all others). A null conversation id is a conversation of its own. Empty texts
are blank. Very long texts pass once, whole. Equal rows of one turn: all but the first are repeated.
An empty table gives no rows. Further columns are not read.
"""
from __future__ import annotations

import hashlib
import uuid
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fansignal.llm.shared_files import file_system

BLOCK = 1_000_000          # turns of a conversation whose choices are held in memory
BLANKS = " \t\n\x0b\x0c\r"
REPORT = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
TURNS = "conv string, position long, role string, text string, edit string"

# Places in the pattern: 0 nothing yet, 1 after the system turn, 2 after user, 3 after assistant.
# Role classes: 0 system, 1 user, 2 assistant, 3 other.
NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
WANTED = (1, 1, 2, 1)      # the user or assistant turn that may come next
ENDS = (0, 3)
ROLE = {1: "user", 2: "assistant"}
EDITS = "DIKR"             # in ASCII order, so the smallest number wins a tie
GOOD, DELETE, TRUNCATED = 0, 1, 2
FAR = 1 << 30


def settle(costs: list[int], edits: list[int]) -> None:
    """Let insertions improve the cost from each place."""
    for _ in range(3):
        for q in range(4):
            c = 5 + costs[NEXT[q, WANTED[q]]]
            if (c, 1) < (costs[q], edits[q]):
                costs[q], edits[q] = c, 1


def at_end() -> list[int]:
    """Cost from each place when no turn is left."""
    costs, edits = [0 if q in ENDS else FAR for q in range(4)], [0] * 4
    settle(costs, edits)
    return costs


def before(costs: tuple[int, ...], role: int, fault: int) -> tuple[tuple[int, ...], int]:
    """Costs in front of a turn, given those behind it, and the best edits as one byte."""
    new, edits = [], []
    for q in range(4):
        best = (2 + costs[q], 0)
        if fault != DELETE:
            more = 5 if fault == TRUNCATED else 0
            if (q, role) in NEXT:
                best = min(best, (more + costs[NEXT[q, role]], 2))
            best = min(best, (more + 1 + costs[NEXT[q, WANTED[q]]], 3))
        new.append(best[0])
        edits.append(best[1])
    settle(new, edits)
    return tuple(new), sum(e << 2 * q for q, e in enumerate(edits))


class Choices:
    """One byte per turn, written from the last turn on and read from the first on; all
    but the newest block is packed and kept in a file of the shared folder."""

    def __init__(self, folder: str, block: int):
        self.folder, self.block, self.now = folder, block, bytearray()
        self.places: list[tuple[int, int]] = []
        self.out = self.file = None
        self.end = 0

    def add(self, byte: int) -> None:
        if len(self.now) >= self.block:
            self._spill()
        self.now.append(byte)

    def _spill(self) -> None:
        if self.out is None:
            self.store, path = file_system(self.folder)
            self.store.create_dir(path, recursive=True)
            self.path = f"{path}/{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(self.path, compression=None)
        packed = zlib.compress(self.now, 1)
        self.out.write(packed)
        self.places.append((self.end, len(packed)))
        self.end += len(packed)
        self.now = bytearray()

    def pop(self) -> int:
        if not self.now:
            if self.out is not None:
                self.out.close()
                self.out, self.file = None, self.store.open_input_file(self.path)
            at, size = self.places.pop()
            self.now = bytearray(zlib.decompress(self.file.read_at(size, at)))
        return self.now.pop()

    def close(self) -> None:
        for f in (self.out, self.file):
            if f is not None:
                f.close()
        if self.out is not None or self.file is not None:
            self.store.delete_file(self.path)
        self.out = self.file = None


class Conversation:
    """The state of one conversation while its turns pass."""

    def __init__(self, conv: str, folder: str, block: int, steps: dict):
        self.conv, self.choices, self.steps = conv, Choices(folder, block), steps
        self.base, self.costs = 0, tuple(at_end())
        self.place, self.position, self.audit = 0, 0, bytearray()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.first = self.last = self.previous = None
        self.distinct, self.hash = 0, hashlib.sha256()

    def back(self, role: int, fault: int) -> None:
        key = (self.costs, role, fault)
        if key not in self.steps:       # costs relative to the least are a small set
            new, byte = before(*key)
            low = min(new)
            self.steps[key] = tuple(c - low for c in new), low, byte
        self.costs, low, byte = self.steps[key]
        self.base += low
        self.choices.add(byte)

    def _emit(self, role: str, text: str, edit: str):
        self.hash.update((f"\n{role}:" if self.position else f"{role}:").encode())
        self.hash.update(text.encode())
        self.position += 1
        return self.conv, self.position - 1, role, text, edit

    def _insert(self):
        role = WANTED[self.place]
        self.audit += b"I"
        self.place = NEXT[self.place, role]
        return self._emit(ROLE[role], "", "I")

    def forth(self, turn: int | None, role: str, text: str, kind: int, fault: str):
        """Repaired turns that this turn gives."""
        if self.previous is not None and (self.previous, kind) not in ((0, 1), (1, 2), (2, 1)):
            self.counts["illegal"] += 1
        self.previous = kind
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.last:
            self.distinct += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        byte = self.choices.pop()
        while (edit := EDITS[byte >> 2 * self.place & 3]) == "I":
            yield self._insert()
        self.audit += edit.encode()
        if edit == "K":
            self.place = NEXT[self.place, kind]
            yield self._emit(role, text, "K")
        elif edit == "R":
            kind = WANTED[self.place]
            self.place = NEXT[self.place, kind]
            yield self._emit(ROLE[kind], text, "R")

    def finish(self):
        while self.place not in ENDS:
            yield self._insert()

    def report(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (self.conv, gaps, *self.counts.values(), self.base + self.costs[0], self.audit.decode(), self.hash.hexdigest())


def _stream(folder: str, block: int, turns: bool, names: list[str]):
    def run(tables):
        steps, now, rows, size = {}, None, [], 0

        def done():
            last = list(now.finish())
            now.choices.close()
            return last if turns else [now.report()]

        try:
            for t in tables:
                for conv, back, kind, fault, has_turn, turn, role, text in t.itertuples(index=False, name=None):
                    if now is None or now.conv != conv:
                        if now is not None:
                            rows += done()
                        now = Conversation(conv, folder, block, steps)
                    if back:
                        if kind is not None and kind >= 0:
                            now.back(kind, DELETE if fault in ("blank", "duplicate") else TRUNCATED if fault else GOOD)
                        continue
                    for r in now.forth(turn if has_turn else None, role, text, kind, fault):
                        if turns:
                            rows.append(r)
                            size += len(r[3])
                    if len(rows) >= 10_000 or size > 32_000_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
            if now is not None:
                rows += done()
            yield pd.DataFrame(rows, columns=names)
        finally:
            if now is not None:
                now.choices.close()
    return run


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv:turn`` modulo 20: 0 drops the
    turn (its row stays with ``absent`` true, so that no conversation is lost), 1 empties the
    text, 2 removes its full stops, exclamation and question marks, 3 repeats the turn and 4 makes its
    role user. Nulls count as one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = rows.withColumn("fault_code", (F.crc32(F.concat(part(conv), F.lit(":"), part(turn))) % 20).cast("int"))
    code = F.col("fault_code")
    new_text = F.when(code == 1, "").when(code == 2, F.translate(part(text), ".!?", "")).otherwise(part(text))
    return d.select(F.col(conv), F.col(turn), F.when(code == 4, "user").otherwise(part(role)).alias(role), new_text.alias(text),
                    (code == 0).alias("absent"),
                    F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _fault(text: Column, seen: Column) -> Column:
    """The first fault of a turn: blank, duplicate, truncated, or the empty text."""
    inner = F.rtrim(text, F.lit(BLANKS))
    return (F.when(inner == "", "blank").when(seen, "duplicate")
            .when(~F.right(inner, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise(""))


def streamed(rows: DataFrame, turns: bool, conv: str, turn: str, role: str, text: str, absent: str | None, block: int) -> DataFrame:
    """Both passes of all turns, dealt by conversation and sorted, through the stream."""
    from fansignal.session import shared_dir
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = rows.select(F.coalesce(F.concat(F.lit("1"), F.col(conv).cast("string")), F.lit("0")).alias("conv"), F.col(turn).cast("long").alias("turn"),
                    blank(role).alias("role"), blank(text).alias("text"),
                    (F.coalesce(F.col(absent), F.lit(False)) if absent else F.lit(False)).alias("absent"))
    d = d.withColumn("same", F.when(~F.col("absent"), F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    d = d.repartition("conv")                          # the one shuffle; what follows sorts inside it
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    d = d.withColumn("place", F.row_number().over(Window.partitionBy("conv").orderBy(*order)).cast("long"))
    d = d.withColumn("seen", F.row_number().over(Window.partitionBy("conv", "same").orderBy("place")) > 1)
    initial = F.left("role", F.lit(1))
    kind = F.when(F.col("absent"), -1).when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    d = d.withColumns({"kind": kind.cast("int"), "fault": _fault(F.col("text"), F.col("seen"))})
    # an absent row only marks its conversation, on the way back
    twice = F.when(F.col("absent"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    d = d.withColumn("back", F.explode(twice))
    d = d.sortWithinPartitions("conv", F.col("back").desc(), F.when(F.col("back"), -F.col("place")).otherwise(F.col("place")))
    d = d.select("conv", "back", "kind", "fault", F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn"),
                 F.when(F.col("back"), "").otherwise(F.col("role")).alias("role"), F.when(F.col("back"), "").otherwise(F.col("text")).alias("text"))
    schema = TURNS if turns else REPORT
    out = d.mapInPandas(_stream(f"{shared_dir(rows.sparkSession)}/choices", block, turns, [c.split()[0] for c in schema.split(", ")]), schema)
    named = F.when(F.col("conv") != "0", F.substr("conv", F.lit(2))).cast(rows.schema[conv].dataType)
    return out.select(named.alias(conv), *out.columns[1:])


def repair_report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  absent: str | None = "absent", block: int = BLOCK) -> DataFrame:
    """One row per conversation: gaps in its turns, counts of faults, cost and initials of the
    cheapest edits, and the SHA-256 of the repaired ``role:text`` lines. Rows with ``absent`` true
    are no turns; a conversation of such rows only has zeros and nothing repaired."""
    return streamed(rows, False, conv, turn, role, text, absent, block)


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   absent: str | None = None, block: int = BLOCK) -> DataFrame:
    """The repaired conversations: conversation, position from 0, role, text and edit (K, R or I)."""
    return streamed(rows, True, conv, turn, role, text, absent, block)
