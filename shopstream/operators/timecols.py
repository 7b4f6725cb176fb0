"""Time-column helpers that behave the same for TIMESTAMP and TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampNTZType

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def is_ntz(df: DataFrame, name: str = "ts") -> bool:
    return isinstance(df.schema[name].dataType, TimestampNTZType)


def epoch_micros(df: DataFrame, name: str = "ts") -> Column:
    """Microseconds since the epoch; independent of the session time zone."""
    if is_ntz(df, name):
        return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH_NTZ}, `{name}`)")
    return F.unix_micros(F.col(name))


def from_micros(df: DataFrame, micros: Column, name: str = "ts") -> Column:
    """The time ``micros`` after the epoch, in the type of the column ``name``."""
    if is_ntz(df, name):
        return F.expr(_EPOCH_NTZ) + F.make_dt_interval(
            secs=(micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
    return F.timestamp_micros(micros)


def truncate(df: DataFrame, unit: str, name: str = "ts") -> Column:
    """``date_trunc(unit, ts)`` keeping the column's own timestamp type."""
    out = F.date_trunc(unit, F.col(name))
    return out.cast("timestamp_ntz") if is_ntz(df, name) else out
