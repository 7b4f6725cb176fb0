"""Replaying an event table as a stream: files in arrival order, a bounded number per micro-batch."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# State in RocksDB: point lookups instead of a task's whole state in memory, and a batch uploads its changes alone.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

PARTITIONS = "spark.sql.shuffle.partitions"


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run in the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def state_conf(spark: SparkSession, keys: int | None = None) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own settings come back after.

    ``keys``: their state has so many keys at most.  More partitions than that would open empty stores in every batch.
    """
    conf = dict(STATE_CONF)
    if keys is not None:
        conf[PARTITIONS] = str(min(keys, int(spark.conf.get(PARTITIONS))))
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_arrivals(events: DataFrame, folder: str, files: int, arrival: Column) -> None:
    """The events as ``files`` Parquet files, each holding a range of ``arrival``.

    File times ascend with the ranges: a file stream reads them in that order.
    """
    spark = events.sparkSession
    order = events.withColumn("_arrival", arrival)
    order.repartitionByRange(files, "_arrival").sortWithinPartitions("_arrival").drop("_arrival").write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")),
                   key=lambda p: p.getName())
    last = max((fs.getFileStatus(p).getModificationTime() for p in found), default=0)
    for i, p in enumerate(found):                        # seconds apart and in the past: coarse clocks keep the order
        fs.setTimes(p, last - 1000 * (len(found) - i), -1)


def read_arrivals(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """The files as a stream, in the order of their times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch)).parquet(folder)


def replay(events: DataFrame, folder: str, files: int, arrival: Column | None = None, files_per_batch: int = 1) -> DataFrame:
    """``events`` written in the order of ``arrival`` (default: ``seq``) and read back as a stream."""
    write_arrivals(events, folder, files, F.col("seq") if arrival is None else arrival)
    return read_arrivals(events.sparkSession, folder, events.schema, files_per_batch)
