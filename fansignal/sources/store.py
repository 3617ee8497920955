"""Tables with a declared schema, and the training-set export."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name.lower(), f.dataType.simpleString()) for f in schema.fields]


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, path: str | None = None) -> bool:
    """Create the table with its declared schema; True if it was created, False if it is
    there with that schema. A table of that name with other columns or types is refused,
    never changed. Nullability is not compared: files always store nullable columns."""
    if spark.catalog.tableExists(name):
        have, want = _shape(spark.table(name).schema), _shape(schema)
        if have != want:
            diff = sorted(set(have) ^ set(want)) or "another order of columns"
            raise ValueError(f"table {name} exists with another schema: {diff}")
        return False
    spark.catalog.createTable(name, path=path, source="parquet", schema=schema)
    return True


def append_checked(df: DataFrame, name: str) -> None:
    """Append rows whose columns, in any order, are those of the table; others are refused."""
    want = df.sparkSession.table(name).schema
    if sorted(_shape(df.schema)) != sorted(_shape(want)):
        raise ValueError(f"rows do not fit {name}: {sorted(set(_shape(df.schema)) ^ set(_shape(want)))}")
    df.select(*[f.name for f in want.fields]).write.mode("append").insertInto(name)


def export_training_csv(frame: DataFrame, path: str, features: list[str], label: str = "label") -> None:
    """CSV without header, label first, then the features; rows without a label are left
    out, as a trainer cannot read them. One file per task, written by the executors."""
    frame.filter(frame[label].isNotNull()).select(label, *features).write.csv(path, header=False, nullValue="")


def read_training_csv(spark: SparkSession, path: str, features: list[str], label: str = "label") -> DataFrame:
    """The export read back with its types."""
    schema = T.StructType([T.StructField(label, T.IntegerType()), *[T.StructField(f, T.DoubleType()) for f in features]])
    return spark.read.csv(path, schema=schema, header=False, mode="FAILFAST")
