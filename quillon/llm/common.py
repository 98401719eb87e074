"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.tables import write_shared

#: Fixed value: what separates words everywhere in this subpackage (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"


def files_for(spark: SparkSession, rows: int, each: int = 1_000_000) -> int:
    """How many tasks and files a table of so many narrow rows deserves: all cores, more as it grows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def materialise(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, so a lost
    executor costs only the tasks it was running. The reader has no memory of how rows were
    dealt out, which leaves a later join free to split its hot partitions. `files` bounds the
    number of files where the row count is known and a file for each partition would be tiny."""
    if files:
        df = df.coalesce(files)
    path = write_shared(df)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._quillon_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table made by materialise()."""
    path = getattr(df, "_quillon_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo a number; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lowered; bytes.split() parts at exactly the WORD gaps."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the SplitMix64 constants are fixed values)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def seeded(count: int, seed: int) -> np.ndarray:
    """count reproducible 64-bit values."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def need(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only the columns an operator reads, so that clashing extra ones cannot matter."""
    return df.select(*columns)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, and that stays free with one underscore more."""
    taken = {c.lower() for c in df.columns}
    while name in taken or f"{name}_" in taken:
        name += "__"
    return name
