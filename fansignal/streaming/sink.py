"""A03, A05, A06 on a stream: a sink that takes every micro-batch once.

``EpochTable`` keeps the rows of each epoch in a folder of their own and a manifest per
epoch. A batch becomes visible when its manifest does; a batch that is run again (after
a crash between the two, or a replay) finds its manifest and changes nothing, and rows
whose manifest never came are never read. Epochs are counted per writer, and the writer
is the id that Spark stores in the query's checkpoint, so a new checkpoint is a new
writer and never taken for a replay.

``latest`` is the upsert view: the newest row of each key over all epochs. ``compact``
writes the committed epochs (merged by key if one is given) as one snapshot, so that neither
the number of manifests nor the rows per key grow with the age of the stream.
"""
from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fansignal.sources.published import Folder, write_version


class EpochTable:
    """A table that grows by epochs: ``data/<version>`` folders, ``epochs`` and ``snapshots``
    manifests. One writer at a time may compact; any number of readers may read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.data = f"{self.path}/data"
        self.epochs, self.snapshots = Folder(spark, f"{self.path}/epochs"), Folder(spark, f"{self.path}/snapshots")

    @staticmethod
    def _name(writer: str, epoch: int) -> str:
        return f"{hashlib.sha256(writer.encode()).hexdigest()[:16]}-{epoch:012d}.json"

    def _snapshot(self) -> dict:
        names = self.snapshots.names()
        return self.snapshots.read(names[-1]) if names else {"number": 0, "version": None, "last": {}, "schema": None}

    def committed(self, writer: str, epoch: int) -> bool:
        """Whether the epoch is in the table, by its manifest or inside the snapshot."""
        name = self._name(writer, epoch)
        return self._snapshot()["last"].get(name[:16], -1) >= epoch or name in self.epochs.names()

    def commit(self, batch: DataFrame, writer: str, epoch: int, partition_by: list[str] | None = None) -> bool:
        """Add the rows of one epoch; False, and no change, if it is there already."""
        if self.committed(writer, epoch):
            return False
        version = write_version(batch, self.data, partition_by)
        return self.epochs.publish(self._name(writer, epoch), {"version": version, "epoch": epoch, "writer": writer, "schema": batch.schema.json()})

    def _open(self) -> tuple[dict, list[tuple[str, dict]]]:
        snapshot = self._snapshot()
        live = [(n, self.epochs.read(n)) for n in self.epochs.names()]
        return snapshot, [(n, m) for n, m in live if m["epoch"] > snapshot["last"].get(n[:16], -1)]

    def read(self) -> DataFrame | None:
        """All committed rows; None while there is no epoch. The column epoch_seq tells the
        order of commits: 0 for the snapshot, then the epochs."""
        snapshot, live = self._open()
        parts = [(snapshot, 0)] if snapshot["version"] else []
        parts += [(m, m["epoch"] + 1) for _, m in live]
        # with the stored schema an epoch without rows, and so without files, can be read as well
        frames = [self.spark.read.schema(T.StructType.fromJson(json.loads(m["schema"]))).parquet(f"{self.data}/{m['version']}")
                  .withColumn("epoch_seq", F.lit(s).cast("long")) for m, s in parts]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None

    def latest(self, key: list[str], order: list[str]) -> DataFrame | None:
        """The newest row of each key by ``order`` (nulls oldest), then by commit, then by its
        other columns, so ties have one result; one partial aggregation."""
        d = self.read()
        return None if d is None else latest_rows(d, key, [*order, "epoch_seq"])

    def compact(self, key: list[str] | None = None, order: list[str] | None = None) -> None:
        """Merge what is committed into one snapshot and drop the manifests it replaces."""
        snapshot, live = self._open()
        if not live:
            return
        d = self.latest(key, order or []) if key else self.read()
        last = dict(snapshot["last"])
        for n, m in live:
            last[n[:16]] = max(last.get(n[:16], -1), m["epoch"])
        number = snapshot["number"] + 1
        d = d.drop("epoch_seq")
        version = write_version(d, self.data)
        self.snapshots.publish(f"{number:012d}.json", {"number": number, "version": version, "last": last, "schema": d.schema.json()})
        for n, _ in live:          # their rows are in the snapshot; readers skip them already
            self.epochs.delete(n)


def latest_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest ``order`` (nulls last of all), ties by the
    remaining columns that can be ordered."""
    rest = [f.name for f in rows.schema.fields if f.name not in (*key, *order)]
    comparable = [f.name for f in rows.schema.fields if f.name in rest and f.dataType.typeName() not in ("map", "variant")]
    rank = F.struct(*[F.struct(F.col(c).isNotNull().alias("known"), F.col(c).alias("at")) for c in order], *comparable)
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), rank).alias("s"))
    return picked.select(*key, "s.*").select(*rows.columns)


def writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave the query whose checkpoint this is."""
    return Folder(spark, checkpoint).read("metadata")["id"]


def write_epochs(df: DataFrame, path: str, checkpoint: str, trigger: str | None = "10 seconds", available_now: bool = False,
                 partition_by: list[str] | None = None, compact_every: int = 0, key: list[str] | None = None, order: list[str] | None = None):
    """A streaming query into an ``EpochTable``, each micro-batch exactly once in what
    readers see. ``available_now`` drains what is there and stops (the final flush). With
    ``compact_every`` the table is compacted, by ``key`` and ``order`` if given, every so many
    epochs."""
    def sink(batch: DataFrame, epoch: int):
        spark = batch.sparkSession
        table = EpochTable(spark, path)
        table.commit(batch, writer_of(spark, checkpoint), epoch, partition_by)
        if compact_every and epoch % compact_every == compact_every - 1:
            table.compact(key, order)
    w = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()
