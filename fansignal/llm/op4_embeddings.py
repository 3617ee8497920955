"""Embedding near-deduplication by a subspace pigeonhole join.

Unit vectors with cosine >= t are at a squared distance of at most 2 (1 - t). Vectors are
rotated by a fixed random rotation, so no direction is special, and split into blocks of
few dimensions. If every block were farther apart than its share of that budget (in
proportion to its dimensions), the whole would be too: so every pair to be found is within
budget in some block. Each block is a range join: vectors are dealt to cells as wide as the
block's radius along its first coordinate, so partners are in the same or in the next cell;
inside a cell, block distances decide about candidates. A pair counts in its first block
within budget only, so the union of the blocks needs no removal of repeats, and is then
verified by its exact cosine in double precision.

Vectors of one label (and length) only meet each other. A label with more than CELL_ROWS
vectors is dealt to several sub-cells by a hash of the id, and each pair of sub-cells is a
group of its own, so a group stays bounded if a label, a cell or a group of near copies
holds a third of all rows. Groups send one row per linked vector (links, smallest vector
reached inside the group), never the pairs.

Null, empty or zero vectors, those with null or non-finite components, and null labels or
ids link with nothing. Rows that repeat a vec_id count as one vector: the smallest
(label, embedding). Other columns are ignored. An empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fansignal.llm.graph import connected_components
from fansignal.sources.tables import staged

BLOCKS = 8
CELL_ROWS = 8192
SLACK = 1e-9       # for rounding; candidates are verified anyway
AT_ONCE = 20_000   # candidate pairs verified at a time


# Plain dictionaries: they travel to workers that do not have this package, as the functions do.
_ROTATIONS: dict[int, np.ndarray] = {}
_CUTS: dict[int, list[slice]] = {}


def _rotation(dim: int) -> np.ndarray:
    if dim not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(20).standard_normal((dim, dim)))
        _ROTATIONS[dim] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim]


def _blocks(dim: int) -> list[slice]:
    if dim not in _CUTS:
        cuts = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
        _CUTS[dim] = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return _CUTS[dim]


def _budgets(dim: int, least: float) -> np.ndarray:
    return np.array([(2 * (1 - least) + SLACK) * (b.stop - b.start) / dim for b in _blocks(dim)])


def _units(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _deal(least: float):
    """Rows (dim, block, cell, s, t, role) per vector: role 0 meets all others of its group,
    1 is a later sub-cell of the same cell, 2 comes from the next lower cell."""
    def run(batches):
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            label, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            subs = batch.column(2).to_pylist()
            out: list[tuple] = []
            for row, vec in enumerate(batch.column(3)):
                v = np.array(vec.as_py(), float)
                dim, s = len(v), subs[row]
                z = _units(v[None])[0] @ _rotation(dim)
                salt, raw = ids[row] * 0x9E3779B97F4A7C15 % (1 << 64) % 1_000_003 % s, v.tobytes()
                for b, (part, budget) in enumerate(zip(_blocks(dim), _budgets(dim, least), strict=True)):
                    cell = int(np.floor(z[part.start] / np.sqrt(budget)))
                    for other in range(s):
                        out.append((label[row], dim, b, cell, salt, other, 0, ids[row], raw))
                        if other < salt:
                            out.append((label[row], dim, b, cell, other, salt, 1, ids[row], raw))
                        out.append((label[row], dim, b, cell + 1, other, salt, 2, ids[row], raw))
            cols = list(zip(*out, strict=True)) if out else [()] * 9
            types = [batch.schema.field(1).type, *[pa.int32()] * 6, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)],
                                             ["label", "dim", "block", "cell", "s", "t", "role", "vec_id", "vec"])
    return run


def _union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the trees of i and j; every node then points at the smallest node of its tree."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


def _links(least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("role", "ascending")])
        dim, block, one, two = (table.column(c)[0].as_py() for c in ("dim", "block", "s", "t"))
        ids = np.array(table.column("vec_id"))
        role = np.array(table.column("role"))
        u = _units(np.frombuffer(b"".join(x.as_py() for x in table.column("vec")), float).reshape(-1, dim))
        z, parts, budgets = u @ _rotation(dim), _blocks(dim), _budgets(dim, least)
        x = z[:, parts[block]]
        norm, n = (x * x).sum(1), len(ids)
        count, parent = np.zeros(n, np.int64), np.arange(n)
        home = np.flatnonzero(role == 0)
        for at in range(0, len(home), 512):
            rows = home[at:at + 512]
            near = norm[rows][:, None] + norm[None, :] - 2 * (x[rows] @ x.T) <= budgets[block] + SLACK
            # home vectors are in the groups of every other sub-cell: they meet each other in one of them only
            near &= (role != 0)[None, :] | ((one == two) & (rows[:, None] < np.arange(n)[None, :]))
            a, b = np.nonzero(near)
            a = rows[a]
            for k in range(0, len(a), AT_ONCE):
                i, j = a[k:k + AT_ONCE], b[k:k + AT_ONCE]
                gap = np.add.reduceat((z[i] - z[j]) ** 2, [p.start for p in parts[:block + 1]] +
                                      ([parts[block].stop] if block + 1 < len(parts) else []), axis=1)[:, :block + 1]
                first = (gap[:, block] <= budgets[block]) & ~(gap[:, :block] <= budgets[:block]).any(1)
                linked = first & (np.einsum("ij,ij->i", u[i], u[j]) >= least) & (ids[i] != ids[j])
                i, j = i[linked], j[linked]
                count += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
                parent = _union(parent, i, j)
        has = np.flatnonzero(count)
        return pa.table({"vec_id": pa.array(ids[has]), "n": pa.array(count[has]), "root": pa.array(ids[parent[has]])})
    return run


def embedding_links(embeddings: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector."""
    every = (embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                               F.col(vector_col).cast("array<double>").alias("vec"))
             .groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("v")).select("vec_id", "v.label", "v.vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = every.filter("vec_id is not null and label is not null and size(vec) > 0").filter(
        sound & F.exists("vec", lambda x: x != 0))
    usable = staged(usable.withColumn("dim", F.size("vec")), "vectors")
    groups = usable.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("subs"))
    dealt = (usable.join(groups, ["label", "dim"]).select("vec_id", "label", "subs", "vec")
             .mapInArrow(_deal(least), f"label {usable.schema['label'].dataType.simpleString()}, dim int, block int, cell int, "
                                       "s int, t int, role int, vec_id long, vec binary"))
    found = staged(dealt.groupBy("label", "dim", "block", "cell", "s", "t")
                   .applyInArrow(_links(least), "vec_id long, n long, root long"), "vector-links")
    comp = connected_components(found, "vec_id", "root")
    n = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    return (every.select("vec_id").join(n, "vec_id", "left")
            .join(comp.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"),
                    F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept")))
