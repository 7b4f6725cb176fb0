"""Batch sinks: the report export (S6) and versioned table writes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a report (e.g. the one-row dashboard) as JSON or Parquet.

    The report is small by construction, so one output file is written.
    """
    (df.coalesce(1).write.mode("overwrite").format(fmt).save(path))
