"""Merkle dataset manifest: leaves, node levels, subroots per source, root and proofs.

A leaf is the SHA-256 (lowercase hex) of a row's fields, each written as ``-`` if null and
else as its number of UTF-8 bytes, a colon and the value. Per group (source) the leaves
ascend by id and ``fanout`` consecutive nodes become one parent until one node remains, the
subroot; the subroots, ordered by group (null first, bytewise), become the root likewise.

Positions come from a range partitioning by (group, id): each partition numbers its rows,
and a small table of counts per (partition, group) gives each its offset. So a hot group is
dealt over many tasks. Per level, the windows run over single runs of ``fanout`` nodes:
lag and lead at fixed offsets, masked by the slot in the run and the length of the run,
give the siblings, and the row of the first child hashes the parent. A level is written
to the shared folder before the next one reads it. Proofs go down again: a node's path is
its own siblings followed by its parent's path, joined on the key of the run, by which the
windows have dealt the rows already.

Nulls: a null id is the smallest, a null group a group of its own. Rows that repeat an id
go by their leaf; entirely equal rows are each a leaf. Empty texts are values of 0 bytes,
different from null; very long ones are hashed whole. An empty table gives no rows and no
root. Input columns other than the named ones are not read.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fansignal.sources.tables import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """A field as it enters the leaf hash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (0-based place in its group by ``order``) and ``n`` (rows of
    the group). ``group`` holds no nulls. No group is brought into one task."""
    # the last key only spreads equal rows over partitions
    spread = rows.withColumn("row_key", F.monotonically_increasing_id())
    keys = [group, *order, "row_key"]
    dealt = staged(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row_key")
                   .withColumn("at", F.monotonically_increasing_id()), "manifest-order")
    part = F.shiftright("at", 33).alias("part")
    # one row per (partition, group): bounded by partitions plus groups
    counts = dealt.groupBy(F.col(group), part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    by_part = Window.partitionBy(group).orderBy("part")
    offsets = counts.select(
        F.col(group).alias("o_group"), F.col("part").alias("o_part"),
        (F.coalesce(F.sum("c").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("c").over(Window.partitionBy(group)).alias("n"))
    j = dealt.join(offsets, (F.col(group) == F.col("o_group")) & (F.shiftright("at", 33) == F.col("o_part")))
    return j.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "shift", "o_group", "o_part")


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes (g, pos, n, h) of groups with several nodes, with ``run`` (parent's place),
    ``slot``, and the digests of the run's nodes before (``left``) and after (``right``)."""
    slot, run = F.col("slot"), F.col("run")
    d = (nodes.filter("n > 1").withColumn("run", F.floor(F.col("pos") / fanout).cast("long"))
         .withColumn("slot", F.col("pos") % fanout))
    length = F.least(F.lit(fanout), F.col("n") - run * fanout)
    w = Window.partitionBy("g", "run").orderBy("pos")
    before = [F.when(slot >= i, F.lag("h", i).over(w)) for i in range(fanout - 1, 0, -1)]
    after = [F.when(slot + i < length, F.lead("h", i).over(w)) for i in range(1, fanout)]
    return d.withColumns({"left": F.concat_ws("", *before), "right": F.concat_ws("", *after)})


def parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """The next level: the first child's row hashes the run."""
    return (with_siblings(nodes, fanout).filter("slot = 0")
            .select("g", F.col("run").alias("pos"), F.ceil(F.col("n") / fanout).cast("long").alias("n"),
                    F.sha2(F.concat("h", "right"), 256).alias("h")))


def node_levels(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """Levels from the leaves (g, pos, n, h) up; a group ends at the level where n = 1."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(staged(parents(levels[-1], fanout), "manifest-level"))
        most = -(-most // fanout)
    return levels


def with_paths(level: DataFrame, above: DataFrame | None, tops: DataFrame, fanout: int) -> DataFrame:
    """Nodes of a level with ``path``: the siblings from the node up to the root, lowest
    first. ``above`` are the paths of the next level, ``tops`` those of the subroots."""
    tops = tops.select(F.col("g").alias("t_g"), "path", "subroot", "root")
    top = level.filter("n = 1").join(tops, F.col("g") == F.col("t_g")).drop("t_g")
    if above is None:
        return top
    up = above.select(F.col("g").alias("u_g"), F.col("pos").alias("u_run"), F.col("path").alias("u_path"), "subroot", "root")
    step = F.array(F.struct("left", "right"))
    low = (with_siblings(level, fanout).join(up, (F.col("g") == F.col("u_g")) & (F.col("run") == F.col("u_run")))
           .withColumn("path", F.concat(step, "u_path")))
    return low.select(*top.columns).unionByName(top)


def paths(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """Leaves with their whole path, subroot and root; see ``with_paths``."""
    above = None
    for k in range(len(levels) - 1, -1, -1):
        above = with_paths(levels[k], above, tops, fanout)
        if k:
            above = staged(above.select("g", "pos", "path", "subroot", "root"), "manifest-paths")
    return above


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf digest and its path lead to."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(rows: DataFrame, fields: list[str], group: str, order: str, fanout: int = 16,
             carried: dict[str, Column] | None = None) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(leaves, levels, subroots) of a table.

    leaves: ``order``, ``leaf``, the ``carried`` columns (expressions over the input row),
    ``path`` (array of left and right siblings, lowest level first), ``subroot``, ``root``.
    levels: the node tables (g, pos, n, h) from the leaves up, per group. subroots: g,
    ``subroot``, ``path`` to the root, ``root``. g is the group's value after ``1``, or
    ``0`` for null, which sorts null first and else bytewise."""
    carried = carried or {}
    taken = ("g", "pos", "n", "h", "run", "slot", "left", "right", "path", "subroot", "root", "leaf", order)
    if clash := [c for c in carried if c in taken]:
        raise ValueError(f"carried columns clash: {clash}")
    g = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    # one scan of the texts; from here on rows are digests
    hashed = staged(rows.select(g.alias("g"), F.col(order).alias("leaf_order"), row_digest(*[F.col(f) for f in fields]).alias("h"),
                                *[c.alias(name) for name, c in carried.items()]), "manifest-leaves")
    leaves = staged(numbered(hashed, "g", ["leaf_order", "h"]), "manifest-positions")
    levels = node_levels(leaves, fanout)
    subroots = reduce(DataFrame.unionByName, [x.filter("n = 1").select("g", F.col("h").alias("subroot")) for x in levels])
    subroots = subroots.select(F.lit("").alias("one"), F.col("g").alias("name"), "subroot")
    tops = staged(numbered(subroots, "one", ["name"])
                  .select(F.col("one").alias("g"), "pos", "n", F.col("subroot").alias("h"), F.col("name").alias("member")), "manifest-tops")
    upper = node_levels(tops, fanout)
    root = upper[-1].filter("n = 1").select("g", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"), F.col("h").alias("root"))
    tops = staged(paths(upper, root, fanout).select(F.col("member").alias("g"), F.col("h").alias("subroot"), "path", "root"), "manifest-subroots")
    out = paths(levels, tops, fanout).select(F.col("leaf_order").alias(order), F.col("h").alias("leaf"), *carried, "path", "subroot", "root")
    return out, levels, tops


def tampered_digest(fields: list[str], text: str, id_col: str, every: int = 5) -> Column:
    """The leaf digest after tampering (the text's A-Z lower-cased) in the rows whose
    unsigned crc32 of the decimal id ``every`` divides; null in all other rows."""
    hit = F.crc32(F.col(id_col).cast("string")) % every == 0
    return F.when(hit, row_digest(*[F.translate(f, UPPER, LOWER) if f == text else F.col(f) for f in fields]))


def verified_documents(documents: DataFrame) -> DataFrame:
    """The manifest of ``documents`` with a proof check per row: doc_id, leaf, subroot,
    root, proof_sha256, folded_root (from the tampered leaf where a row is tampered with)
    and verified."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaves, _, _ = manifest(documents, fields, "source", "doc_id",
                            carried={"tampered": tampered_digest(fields, "text", "doc_id")})
    checked = leaves.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return checked.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                          "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
