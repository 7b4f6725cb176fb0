"""Event-time streaming metrics with watermarks (T3, T8, T9) and the raw
event archive (S5).

Stream timestamps must be TIMESTAMP (``withWatermark`` rejects
TIMESTAMP_NTZ), so the canonical NTZ column is read as UTC wall time.
Spark rejects ``count_distinct`` in streaming aggregations.  Sliding windows
count distinct users with two chained aggregations ((window, user), then
window); session windows, which merge as events arrive, use
``size(collect_set(...))`` per session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.money import money_sum
from ..operators.events import purchases
from ..schema import UNKNOWN


def event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def revenue_window_stream(events: DataFrame, duration: str = "1 minute",
                          watermark: str = "1 minute") -> DataFrame:
    """D1 / D2 on a stream: closed windows are emitted once (append mode)."""
    paid = purchases(event_time(events)).withWatermark("ts", watermark)
    return (paid.groupBy(F.window("ts", duration).alias("w"))
            .agg(money_sum("amount").alias("revenue"), F.count(F.lit(1)).alias("purchases"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "revenue", "purchases"))


def sliding_users_stream(events: DataFrame, length: str = "5 minutes", slide: str = "1 minute",
                         watermark: str = "1 minute") -> DataFrame:
    """D5 on a stream: exact distinct users per sliding window.

    Two chained stateful aggregations (append mode, one watermark): first one
    row per (window, user), then a count per window.  The distinct set is
    thus spread over (window, user) state keys instead of one window's set
    in one task.
    """
    ev = event_time(events).withWatermark("ts", watermark)
    user = F.coalesce(F.col("user_id"), F.lit(UNKNOWN))
    per_user = (ev.groupBy(F.window("ts", length, slide).alias("w"), user.alias("user_id"))
                .agg(F.count(F.lit(1)).alias("n")))
    return (per_user.groupBy(F.col("w").alias("w2")).agg(F.count(F.lit(1)).alias("active_users"))
            .select(F.col("w2.start").alias("window_start"), F.col("w2.end").alias("window_end"),
                    "active_users"))


def session_stream(events: DataFrame, gap: str = "5 minutes", watermark: str = "1 minute") -> DataFrame:
    """A6 on a stream: closed global sessions with their distinct users.

    Spark refuses a session window without a grouping key, and folds a
    literal key away, so the key is a per-row expression that is always 0.
    All open sessions live under that one key: the state is one session's
    user set, bounded by the user population but held by one task.  The
    snapshot processor (``processor.merge_batch``) keeps the same history with
    membership as a distributed table; prefer it when users are many.
    """
    ev = event_time(events).withWatermark("ts", watermark)
    always_zero = F.coalesce(F.length(F.col("event_type")) * 0, F.lit(0)).alias("_global")
    user = F.coalesce(F.col("user_id"), F.lit(UNKNOWN))
    return (ev.groupBy(F.session_window("ts", gap).alias("s"), always_zero)
            .agg(F.size(F.collect_set(user)).alias("active_users"), F.count(F.lit(1)).alias("events"))
            .select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "active_users", "events"))


def start_append(df: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Write an append-mode streaming result as Parquet."""
    writer = (df.writeStream.outputMode("append").format("parquet")
              .option("path", path).option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def archive_stream(events: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Every decoded event, partitioned by event date for pruning."""
    out = events.withColumn("event_date", F.to_date("ts"))
    writer = (out.writeStream.format("parquet").partitionBy("event_date")
              .option("path", path).option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
