"""Join helpers with an explicit broadcast size check.

A side is broadcast only when Catalyst's size estimate for it (after column
pruning) and, for a stored table, the measured size of its rows are under a
limit; otherwise the join is left to the planner (sort-merge join, with AQE's
runtime broadcast conversion and skew-join splitting as the safety net for hot
keys).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, DatetimeType, NumericType

# Catalyst sizes a parquet scan by its (compressed) file bytes, scaled by
# spark.sql.sources.fileCompressionFactor.  Few distinct values take a byte or
# less a row there, so its estimate can only rule a broadcast out.
DEFAULT_BROADCAST_LIMIT = 32 * 1024 * 1024
BROADCAST_LIMIT_CONF = "shopstream.broadcast.maxBytes"


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` in bytes, or None when unavailable."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    except Exception:  # Spark Connect or an API change: no estimate
        return None
    # py4j hands a Scala BigInt over as a Python int (or as a JVM object)
    return int(size) if isinstance(size, int) else int(str(size.toString()))


def is_stored(df: DataFrame) -> bool:
    """Whether ``df`` is columns and filters over one input, no join or aggregate."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
    except Exception:  # as above
        return False
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    return plan.children().isEmpty()


def stored_bytes(df: DataFrame) -> int:
    """Bytes that the rows of a stored table take in a broadcast (8 a field,
    24 a row, and the texts), by one pass over its columns."""
    texts = [F.octet_length(F.col(f.name) if isinstance(f.dataType, BinaryType) else F.col(f.name).cast("string"))
             for f in df.schema if not isinstance(f.dataType, (NumericType, DatetimeType, BooleanType))]
    rows, *sizes = df.agg(F.count(F.lit(1)), *[F.sum(t) for t in texts]).first()
    return rows * 8 * (len(df.columns) + 3) + sum(s or 0 for s in sizes)


def broadcast_limit(df: DataFrame) -> int:
    try:
        value = df.sparkSession.conf.get(BROADCAST_LIMIT_CONF, None)
    except Exception:
        value = None
    return int(value) if value else DEFAULT_BROADCAST_LIMIT


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    limit = limit if limit is not None else broadcast_limit(df)
    size = estimated_bytes(df)
    return size is not None and size <= limit and (not is_stored(df) or stored_bytes(df) <= limit)


def join_dimension(fact: DataFrame, dim: DataFrame, on: Column | str | list,
                   how: str = "left", limit: int | None = None) -> DataFrame:
    """Join a (possibly large) fact side to a dimension side.

    The dimension is broadcast only behind the size check; beyond it the
    planner's shuffle join runs, and AQE splits skewed fact partitions.  A
    stored dimension gets a hint for it, as the planner's own threshold goes by
    the size of the files.
    """
    if fits_broadcast(dim, limit):
        dim = F.broadcast(dim)
    elif is_stored(dim):
        dim = dim.hint("merge")
    return fact.join(dim, on, how)


def attach_by_key(small: DataFrame, dim: DataFrame, small_key: str, dim_key: str,
                  columns: list[str]) -> DataFrame:
    """Left-join dimension ``columns`` onto a *bounded* row set (a top-k).

    A dimension under the broadcast limit is simply broadcast.  A larger one
    is only scanned, never shuffled: the small side (bounded by its limit) is
    broadcast into a semi join that finds the matches, then the few matches
    are left-joined back to keep every small-side row.
    """
    keyed = small.withColumn("_attach_key", F.col(small_key).try_cast(dim.schema[dim_key].dataType))
    dims = dim.select(F.col(dim_key).alias("_attach_key"), *columns)
    if fits_broadcast(dims):
        # a small dimension: one broadcast lookup, no extra job
        return keyed.join(F.broadcast(dims), "_attach_key", "left").drop("_attach_key")
    wanted = keyed.select("_attach_key")
    found = dims.join(F.broadcast(wanted), "_attach_key", "left_semi")
    return keyed.join(F.broadcast(found), "_attach_key", "left").drop("_attach_key")
