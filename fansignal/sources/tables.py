"""Parquet table access. Column pruning and filter pushdown are left to Catalyst."""
from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


_STORED: dict[tuple, str] = {}


def materialized(spark: SparkSession, name: str, key: str, build) -> DataFrame:
    """Write ``build()`` once per application as a parquet table in the shared folder and
    read it back, so that several plans share it. Another application, and so changed
    inputs or code, never sees it; paths are unique, so two writers never meet."""
    import uuid

    from fansignal.session import shared_dir
    at = (spark.sparkContext.applicationId, name, key)
    if at not in _STORED:
        path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _STORED[at] = path
    return spark.read.parquet(_STORED[at])


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to a fresh path in the shared folder and read it back: cuts the
    lineage, survives lost executors, and is computed once however often it is used.
    Whole texts are best stored with "zstd"."""
    import uuid

    from fansignal.session import shared_dir
    path = f"{shared_dir(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *stored: DataFrame) -> None:
    """Delete tables of ``staged`` that no later plan reads, and let Spark remove the shuffle files of steps
    that are over, which stay until the driver happens to collect its garbage."""
    for df in stored:
        files = df.inputFiles()
        if files:
            at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(files[0])).getParent()
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark._jvm.System.gc()
