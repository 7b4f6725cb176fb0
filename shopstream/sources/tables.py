"""Reading the driver's parquet tables.

Each table is one parquet file (or folder) under ``sf_dir``.  We always read
with the file's own schema and let Catalyst prune columns and push filters
into the scan, so callers should ``select`` only what they need.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Canonical events stored as Parquet (e.g. the S5 archive), with the
    fixed schema - no inference; date partitions are pruned by filters."""
    from ..schema import CANONICAL_SCHEMA
    return spark.read.schema(CANONICAL_SCHEMA).parquet(path)


def stream_canonical(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S1 as a stream: new Parquet files of canonical events."""
    from ..schema import CANONICAL_SCHEMA
    reader = spark.readStream.schema(CANONICAL_SCHEMA).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)
