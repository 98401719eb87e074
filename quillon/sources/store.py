"""Results kept as a table in parts, one for each group of keys, of which a write touches no others."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillon.operators.verdict import merged
from quillon.sources.tables import shared_dir, written

#: Parts of a table: keys go to parts by hash, so that any number of them makes a bounded number of folders.
PARTS = 1024
_PART, _MARKS = "part", "_commits"


def _with_part(df: DataFrame, key: str, parts: int) -> DataFrame:
    return df.withColumn(_PART, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _has(spark: SparkSession, path: str) -> bool:
    fs, target = _files(spark, path)
    return bool(fs.exists(target))


def upsert(path: str, new: DataFrame, keys: Sequence[str] = ("cve", "binary"), order: str = "written", parts: int = PARTS, commit: str | None = None) -> str:
    """Merges rows into the table at a path, the latest of each key; gives the commit's name.

    Only the parts that new rows fall into are read and rewritten; they are merged into a table of
    their own first, so a run that dies leaves whole parts, old or new, and running it again under
    the same `commit` name ends in the same table. A commit that has been marked is not done twice.
    The first of `keys` decides the part.
    """
    spark = new.sparkSession
    commit = commit or uuid.uuid4().hex
    if _has(spark, f"{path}/{_MARKS}/{commit}"):
        return commit
    rows = _with_part(new, keys[0], parts)
    if _has(spark, path) and (held := load(spark, path, new.schema)) is not None:
        # a list of the parts touched prunes the scan to their folders
        touched = sorted(r[0] for r in rows.select(_PART).distinct().collect())
        old = held.filter(F.col(_PART).isin(touched)).select(*rows.columns)
    else:
        old = rows.limit(0)
    whole = written(merged(old, rows, tuple(keys), order).select(*rows.columns))
    whole.repartition(_PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(path)
    fs, mark = _files(spark, f"{path}/{_MARKS}/{commit}")
    fs.create(mark, True).close()
    return commit


def load(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The table at a path with its `part`; None before the first write. Names that begin with `_` are no data to Spark."""
    if not _has(spark, path):
        return None
    fs, target = _files(spark, path)
    if not any(s.getPath().getName().startswith(f"{_PART}=") for s in fs.listStatus(target)):
        return None
    reader = spark.read
    if schema is not None:
        reader = reader.schema(StructType([*schema.fields, StructField(_PART, IntegerType())]))
    return reader.parquet(path)


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """The table, written once in buckets of its keys and sorted in them: tables of as many buckets join and group by these keys where they lie.

    It is dealt out by its keys before it is written, so a bucket is one file, and its folder is one in
    the shared folder. A key that stands on most rows makes one large bucket: for such tables leave
    joins to the shuffle, which can split it.
    """
    spark, name = df.sparkSession, f"quillon_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    fs, target = _files(spark, path)
    fs.deleteOnExit(target)
    return spark.table(name)
