"""Small published files and versioned tables in any store Spark can reach.

A file is written under a hidden name and renamed, so a reader sees all of it or nothing.
Tables are written to a fresh folder first and become visible only by such a file (their
manifest); what a failed writer leaves behind is never listed and never read.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """A folder of small text files, through Spark's own file system API on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._new(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        at = self._new(self.path)
        if not self.fs.exists(at):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.fs.listStatus(at)) if n[0] not in "._")

    def read(self, name: str) -> dict:
        stream = self.fs.open(self._new(f"{self.path}/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, name: str, content: dict) -> bool:
        """Make the file appear at once; False if the name is taken."""
        target, hidden = self._new(f"{self.path}/{name}"), self._new(f"{self.path}/.{name}-{uuid.uuid4().hex}")
        if self.fs.exists(target):
            return False
        self.fs.mkdirs(self._new(self.path))
        out = self.fs.create(hidden, True)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        return bool(self.fs.rename(hidden, target))

    def delete(self, name: str) -> None:
        self.fs.delete(self._new(f"{self.path}/{name}"), True)


def write_version(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` to a fresh folder below ``path``; returns the folder's name."""
    name = uuid.uuid4().hex
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path.rstrip('/')}/{name}")
    return name
