"""Token ids of whole documents, packed into fixed-length rows.

Every document becomes its token ids plus one end id; documents longer than a row are cut
into chunks of exactly one row length and a rest, so nothing is lost. Chunks are dealt to
bins of bounded size by a hash; their number follows from the total of text bytes, and a
byte-level token is one byte at least, so no bin's token ids outgrow a task. Inside a bin
chunks are placed by best-fit-decreasing: a segment tree over remaining capacities finds
the fullest row that still takes the chunk in log(row length) steps.

Each output row: pack_id, ids (row_len numbers, padded with the end id), n_tokens (before
padding), cu_seqlens (cumulative segment lengths from 0), position_ids (restart at 0 in
each segment, 0 in the padding), doc_ids and chunk_nos of the segments. Concatenating a
document's chunks in order and dropping its last id (the end) gives its token ids back.

Null or empty texts give no tokens and no segment. Rows that repeat a doc_id are packed
each; a null doc_id is carried as null. An empty table gives no rows. Reruns agree.
"""
from __future__ import annotations

import base64
import sys
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fansignal.sources.tables import staged

BIN_BYTES = 8_000_000  # text bytes per bin, on average


class CapacityTree:
    """Segment tree over capacities 0..size: how many open rows have each capacity left;
    ``take(need)`` finds the smallest capacity >= need that some row has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.n = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        at = self.leaves + capacity
        while at:
            self.n[at] += by
            at >>= 1

    def smallest(self, need: int) -> int:
        """Smallest capacity >= need with an open row, or -1."""
        at = self.leaves + need
        if self.n[at]:
            return need
        while at > 1:
            if not at & 1 and self.n[at + 1]:   # a left child: look right
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.n[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], row_len: int) -> list[list[int]]:
    """Rows as lists of indexes into ``lengths`` (each 1..row_len); ties go by index."""
    rows: list[list[int]] = []
    open_rows: dict[int, list[int]] = {}
    tree = CapacityTree(row_len)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        left = tree.smallest(need)
        if left < 0:
            rows.append([i])
            row, left = len(rows) - 1, row_len
        else:
            row = open_rows[left].pop()
            tree.add(left, -1)
            rows[row].append(i)
        if left > need:
            open_rows.setdefault(left - need, []).append(row)
            tree.add(left - need, 1)
    return rows


class Encoder:
    """Token ids of whole texts by a byte-level rank file; the first free id ends a document."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.end = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2") if self.end < 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _bytes(self, ids: list[int]) -> bytes:
        a = array(self.code, ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """Ids and the end id as little-endian numbers."""
        ids = self.enc.encode_ordinary(text)
        ids.append(self.end)
        return self._bytes(ids)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), self.dtype)[:-1]


def _chunks(rank_file: str, pattern: str, row_len: int):
    schema = pa.schema([("doc_id", pa.int64()), ("chunk_no", pa.int32()), ("ids", pa.binary())])

    def batch_of(docs, nos, ids):
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(nos, pa.int32()), pa.array(ids, pa.binary())], schema=schema)

    def run(batches):
        enc = Encoder(rank_file, pattern)
        step = row_len * enc.dtype.itemsize
        for batch in batches:
            docs, nos, ids, size = [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                t = enc.encode_bytes(text)
                parts = [t] if len(t) <= step else [t[at:at + step] for at in range(0, len(t), step)]
                docs += [doc] * len(parts)
                nos += range(len(parts))
                ids += parts
                size += len(t)
                if size > 16_000_000:
                    yield batch_of(docs, nos, ids)
                    docs, nos, ids, size = [], [], [], 0
            yield batch_of(docs, nos, ids)
    return run


def _pack(row_len: int, end: int, dtype: str):
    def run(table: pa.Table) -> pa.Table:
        order = [("doc_id", "ascending"), ("chunk_no", "ascending"), ("ids", "ascending")]
        table = table.sort_by(order).combine_chunks()
        bin_no = table.column("bin")[0].as_py()
        docs, nos = table.column("doc_id").to_pylist(), table.column("chunk_no").to_pylist()
        ids = [np.frombuffer(x.as_py(), dtype) for x in table.column("ids")]
        rows = best_fit_decreasing([len(x) for x in ids], row_len)
        flat = np.full((len(rows), row_len), end, np.int32)
        pos = np.zeros((len(rows), row_len), np.int32)
        used, cuts = [], []
        for r, parts in enumerate(rows):
            at, cut = 0, [0]
            for p in parts:
                n = len(ids[p])
                flat[r, at:at + n] = ids[p]
                pos[r, at:at + n] = np.arange(n)
                at += n
                cut.append(at)
            used.append(at)
            cuts.append(cut)
        every = pa.array(np.arange(0, (len(rows) + 1) * row_len, row_len), pa.int32())
        return pa.table({
            "pack_id": pa.array([(bin_no << 32) + r for r in range(len(rows))], pa.int64()),
            "n_tokens": pa.array(used, pa.int32()),
            "ids": pa.ListArray.from_arrays(every, pa.array(flat.ravel())),
            "cu_seqlens": pa.array(cuts, pa.list_(pa.int32())),
            "position_ids": pa.ListArray.from_arrays(every, pa.array(pos.ravel())),
            "doc_ids": pa.array([[docs[p] for p in parts] for parts in rows], pa.list_(pa.int64())),
            "chunk_nos": pa.array([[nos[p] for p in parts] for parts in rows], pa.list_(pa.int32()))})
    return run


def packed_sequences(documents: DataFrame, rank_file: str, pattern: str, row_len: int = 2048,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows of all documents (columns in the module text). The rank file must be
    readable on every executor."""
    d = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bins = max(1, -(-total // BIN_BYTES))
    enc = Encoder(rank_file, pattern)
    chunks = d.mapInArrow(_chunks(rank_file, pattern, row_len), "doc_id long, chunk_no int, ids binary")
    dealt = chunks.withColumn("bin", F.pmod(F.xxhash64("doc_id", "chunk_no", "ids"), F.lit(bins)))
    schema = ("pack_id long, n_tokens int, ids array<int>, cu_seqlens array<int>, position_ids array<int>, "
              "doc_ids array<long>, chunk_nos array<int>")
    return dealt.groupBy("bin").applyInArrow(_pack(row_len, enc.end, enc.dtype.str), schema)


FILES = "part string, rows long, row_len int, id_bytes int, segments long"


def _write_files(folder: str, dtype: str):
    def run(batches):
        from pyspark import TaskContext

        from fansignal.llm.shared_files import file_system
        part = f"part-{TaskContext.get().partitionId():06d}"
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        hidden = {kind: f"{root}/.{part}.{kind}-{uuid.uuid4().hex}" for kind in ("ids", "pos", "cu")}
        out = {kind: store.open_output_stream(path, compression=None) for kind, path in hidden.items()}
        rows = segments = row_len = 0
        for b in batches:
            ids, pos, cu = (b.column(b.schema.get_field_index(c)) for c in ("ids", "position_ids", "cu_seqlens"))
            if not b.num_rows:
                continue
            row_len = len(ids[0])
            out["ids"].write(ids.flatten().to_numpy().astype(dtype).tobytes())
            out["pos"].write(pos.flatten().to_numpy().astype("<i4").tobytes())
            for one in cu:      # a row's own count of segments, then its cumulative lengths from 0
                lengths = one.values.to_numpy()
                out["cu"].write(np.concatenate([[len(lengths) - 1], lengths]).astype("<i4").tobytes())
                segments += len(lengths) - 1
            rows += b.num_rows
        for kind, f in out.items():
            f.close()
            if rows:
                store.move(hidden[kind], f"{root}/{part}.{kind}")
            else:
                store.delete_file(hidden[kind])
        if rows:
            yield pa.RecordBatch.from_pylist([{"part": part, "rows": rows, "row_len": row_len, "id_bytes": np.dtype(dtype).itemsize, "segments": segments}],
                                             schema=pa.schema([("part", pa.string()), ("rows", pa.int64()), ("row_len", pa.int32()), ("id_bytes", pa.int32()), ("segments", pa.int64())]))
    return run


def write_packed(packed: DataFrame, folder: str, dtype: str = "<i4") -> DataFrame:
    """Binary output below a fresh ``folder`` of the shared store. Per partition three files of
    little-endian numbers: ``.ids`` (the matrix of rows times row length), ``.pos`` (positions,
    int32, same shape) and ``.cu`` (int32; per row its number of segments and then that many
    cumulative lengths and the leading 0). Returns the stored table of parts with their rows,
    row length, bytes per id and segments; a file appears under its name when it is whole."""
    d = packed.select("ids", "position_ids", "cu_seqlens")
    return staged(d.mapInArrow(_write_files(folder, dtype), FILES), "packed-files")


def read_packed(folder: str, part: str, rows: int, row_len: int, id_bytes: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Ids, positions and cumulative lengths of one part."""
    from fansignal.llm.shared_files import file_system
    store, root = file_system(folder)
    raw = {}
    for kind in ("ids", "pos", "cu"):
        with store.open_input_stream(f"{root}/{part}.{kind}", compression=None) as f:
            raw[kind] = f.read()
    ids = np.frombuffer(raw["ids"], f"<u{id_bytes}").reshape(rows, row_len)
    pos = np.frombuffer(raw["pos"], "<i4").reshape(rows, row_len)
    cu, numbers, at = [], np.frombuffer(raw["cu"], "<i4"), 0
    for _ in range(rows):
        n = int(numbers[at]) + 1
        cu.append(numbers[at + 1:at + 1 + n].tolist())
        at += 1 + n
    return ids, pos, cu
