"""Streams over folders of files: what arrives in deliveries, and running a query over them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.tables import shared_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@contextmanager
def on_disk(spark: SparkSession) -> Iterator[None]:
    """State goes to RocksDB on the executors' disks while a query starts, which typed state needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def catch_up(result: DataFrame, out: str, state: str) -> list[dict]:
    """Runs a stream over all that has arrived, into files, and gives the progress of its batches.

    `state` keeps offsets and state: the next call goes on where this one ended.
    """
    with on_disk(result.sparkSession):
        running = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return [dict(p) for p in running.recentProgress]


def deliver(deliveries: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[dict]]:
    """(results, progress) of a streaming plan over tables that arrive one after the other.

    Each delivery is files in one folder, read by a run of its own that takes up the state of the one
    before: what a service does that is stopped and started again. A batch holds a whole delivery,
    however many files it has, so watermarks move between deliveries and results do not depend on
    how files are cut.
    """
    inbox = state = out = schema = None
    told: list[dict] = []
    for d in deliveries:
        spark = d.sparkSession
        if inbox is None:
            inbox, state, out = scratch(spark), scratch(spark), scratch(spark)
        d.write.mode("append").parquet(inbox)
        result = build(spark.readStream.schema(d.schema).parquet(inbox))
        schema = result.schema
        told += catch_up(result, out, state)
    if out is None:
        raise ValueError("no delivery")
    return spark.read.schema(schema).parquet(out), told
