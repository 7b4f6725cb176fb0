"""Registered stream queries: the event table replayed in several micro-batches, its result checked like a batch query.

Every run lives in a fresh folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import counts
from ..schema import CART_ADDED, PURCHASE_COMPLETED
from ..sources.adapters import shop_events
from ..streaming import carts, corrections, dedup, idle_state
from ..streaming.replay import replay, run_folder, state_conf
from ..streaming.windows import start_append

FILES = 8                    # a replay's files, one or two to a micro-batch


def stream_active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global sessions from keyed state with event-time timers; the open one is read from the state store.

    The replay follows event time: the state drops rows that come later than the watermark, and ids may not ascend with time.
    """
    run = run_folder(spark, "active-sessions")
    out, checkpoint = os.path.join(run, "pieces"), os.path.join(run, "checkpoint")
    events = shop_events(spark, sf_dir, with_names=False).select("seq", "user_id", "ts")
    with state_conf(spark, keys=idle_state.SHARDS):
        # several files to a batch: as many tasks write and read them
        pieces = idle_state.session_pieces(replay(events, os.path.join(run, "source"), 4 * FILES, F.col("ts"), files_per_batch=8))
        idle_state.start_pieces(pieces, out, checkpoint).awaitTermination()
    closed = spark.read.schema(idle_state.PIECES).parquet(out)
    return idle_state.sessions_of_pieces(closed.unionByName(idle_state.open_pieces(spark, checkpoint)), events)


def late_window_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per minute of a replay in which every tenth event comes three of eight files late."""
    run = run_folder(spark, "corrections")
    events = shop_events(spark, sf_dir, only_types=[PURCHASE_COMPLETED], with_names=False)
    span = events.agg(F.struct(F.min("seq").alias("lo"), F.max("seq").alias("hi"))).scalar()
    late = F.when(F.col("seq") % 10 == 3, (span["hi"] - span["lo"]) * 3 / FILES).otherwise(0)
    source = replay(events, os.path.join(run, "source"), FILES, F.col("seq") + late, files_per_batch=2)
    state = os.path.join(run, "state")
    corrections.start_corrections(source, state, os.path.join(run, "checkpoint")).awaitTermination()
    return corrections.window_values(spark, state)


def unpurchased_carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 per user: cart additions that their user doesn't follow by a purchase within a day."""
    run = run_folder(spark, "carts")
    out = os.path.join(run, "carts")
    events = shop_events(spark, sf_dir, only_types=[CART_ADDED, PURCHASE_COMPLETED], with_names=False).select(
        "seq", "event_id", "event_type", "user_id", "ts")
    source = replay(events.unionByName(carts.heartbeat(events, "2 days")), os.path.join(run, "source"), FILES, files_per_batch=2)
    with state_conf(spark):
        start_append(carts.unpurchased_stream(source), out, os.path.join(run, "checkpoint")).awaitTermination()
    return carts.unpurchased_carts(spark.read.schema("event_id string, user_id string, added_at timestamp_ntz, event_type string").parquet(out))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: event counts of a replay where every 5th event comes again, up to seven batches later, and every 7th has no id."""
    run = run_folder(spark, "dedup")
    out = os.path.join(run, "events")
    events = shop_events(spark, sf_dir, with_names=False).select(
        "seq", F.when(F.col("seq") % 7 != 0, F.col("event_id")).alias("event_id"), "event_type", "price", "quantity")
    span = events.agg(F.struct(F.min("seq").alias("lo"), F.max("seq").alias("hi"))).scalar()
    delivered = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("seq") % 5 == 0, 1).otherwise(0))))
    later = F.col("copy") * (F.col("seq") % FILES) * (span["hi"] - span["lo"] + 1) / FILES
    with state_conf(spark):
        source = replay(delivered, os.path.join(run, "source"), FILES, F.col("seq") + later)
        start_append(dedup.unique_events(source), out, os.path.join(run, "checkpoint")).awaitTermination()
    return counts.event_counts(spark.read.schema(source.schema).parquet(out))


def queries() -> dict:
    return {
        "stream_active_sessions": stream_active_sessions,
        "late_window_corrections": late_window_corrections,
        "unpurchased_carts": unpurchased_carts,
        "stream_dedup": stream_dedup,
    }
