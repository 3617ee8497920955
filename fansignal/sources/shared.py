"""Shared results with a time limit.

A result (team features, sentiment, ...) is computed once and stored; every reader within the
limit uses the stored table. A stored result is used only if it was built by the same version of
its definition, from the same input files (their paths, lengths and times before the build) and
published not longer ago than the limit; else it is rebuilt. A new version is written to a fresh folder and
becomes visible by its manifest, so a reader sees the old table or the new one, never half of
one; the versions before the newest ``keep`` go.
"""
from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fansignal.sources.published import Folder, write_version

# Seconds for which the dashboards may reuse a result.
FEATURES_TTL, TIMELINE_TTL, SPIKES_TTL = 300, 60, 120


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files below the paths: name, length and modification time of each."""
    h = hashlib.sha256()
    for p in sorted(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files = []
        if fs.exists(at):
            it = fs.listFiles(at, True)
            while it.hasNext():
                f = it.next()
                files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        h.update(repr((p, sorted(files))).encode())
    return h.hexdigest()


class SharedResults:
    """Stored results below ``root``, by name. ``clock`` gives seconds; tests pass their own."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time, keep: int = 2):
        self.spark, self.root, self.clock, self.keep = spark, root.rstrip("/"), clock, keep
        self.rebuilt = 0

    def _folder(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.root}/{name}/versions")

    def _newest(self, name: str) -> dict | None:
        folder = self._folder(name)
        names = folder.names()
        return folder.read(names[-1]) if names else None

    def fresh(self, name: str, inputs: list[str], ttl: float, definition: str = "1") -> dict | None:
        """The newest version if it may be used now."""
        m = self._newest(name)
        if m is None or m["definition"] != definition or not 0 <= self.clock() - m["built_at"] < ttl:
            return None
        return m if m["inputs"] == fingerprint(self.spark, inputs) else None

    def get(self, name: str, build: Callable[[], DataFrame], inputs: list[str], ttl: float = FEATURES_TTL, definition: str = "1") -> DataFrame:
        """The stored result, rebuilt first if it is missing, old or of other inputs. If two
        rebuild at once, both tables are whole and the one whose manifest came first is read."""
        m = self.fresh(name, inputs, ttl, definition)
        if m is None:
            seen = self._newest(name)
            number = seen["number"] + 1 if seen else 1
            m = {"number": number, "definition": definition, "inputs": fingerprint(self.spark, inputs)}
            m["data"] = write_version(build(), f"{self.root}/{name}/data")
            m["built_at"] = self.clock()        # a build longer than the limit is not old when it ends
            self.rebuilt += 1
            if not self._folder(name).publish(f"{number:012d}.json", m):
                m = self._folder(name).read(f"{number:012d}.json")
            self._expire(name)
        return self.spark.read.parquet(f"{self.root}/{name}/data/{m['data']}")

    def _expire(self, name: str) -> None:
        folder = self._folder(name)
        data = Folder(self.spark, f"{self.root}/{name}/data")
        for old in folder.names()[:-self.keep]:
            data.delete(folder.read(old)["data"])
            folder.delete(old)
