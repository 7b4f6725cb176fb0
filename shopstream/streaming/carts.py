"""Carts without a purchase: an interval outer join of two streams (D3 per user).

A cart addition is *unpurchased* when its user completes no purchase from then on within the interval.  Both
sides carry a watermark and the join condition bounds the time between them, so Spark drops a cart from state
once the watermark is past its interval, emitting it if nothing matched, and a purchase once no cart still to
come can match it: the state holds about an interval of each side.

A user's carts are dealt over ``salts`` join keys and the (rarer) purchases copied to each, so a busy user isn't
one task's work.  A *heartbeat* row (``event_type`` = ``HEARTBEAT``, no user) moves the watermark on where a source
falls silent; it goes through both sides, matches nothing and is left out when the result is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import CART_ADDED, PURCHASE_COMPLETED

HEARTBEAT = "heartbeat"
WITHIN = "1 day"
SALTS = 4


def unpurchased_stream(events: DataFrame, within: str = WITHIN, watermark: str = "1 minute", salts: int = SALTS) -> DataFrame:
    """event_id, user_id, added_at, event_type of carts that ran out (append mode); heartbeats may be among them.

    ``events``: canonical, ``ts`` TIMESTAMP_NTZ.  A cart without a user is never matched.
    """
    timed = events.select("event_id", "event_type", "user_id", F.col("ts").alias("added_at"),
                          F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    carts = timed.where(F.col("event_type").isin(CART_ADDED, HEARTBEAT)).withColumn(
        "salt", F.pmod(F.xxhash64("event_id", "ts"), F.lit(salts)))
    # a heartbeat gets a buyer, else the join's own null check would take it out below the watermark
    buyer = F.when(F.col("event_type") == HEARTBEAT, F.lit(f"\0{HEARTBEAT}")).otherwise(F.col("user_id"))
    paid = (events.select("event_type", buyer.alias("buyer"), F.col("ts").cast("timestamp").alias("paid_at"))
            .withWatermark("paid_at", watermark).where(F.col("event_type").isin(PURCHASE_COMPLETED, HEARTBEAT))
            .select("buyer", "paid_at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("of")))
    same = ((F.col("user_id") == F.col("buyer")) & (F.col("salt") == F.col("of"))
            & (F.col("paid_at") >= F.col("ts")) & (F.col("paid_at") < F.col("ts") + F.expr(f"INTERVAL {within}")))
    return carts.join(paid, same, "left_outer").where("paid_at IS NULL").select("event_id", "user_id", "added_at", "event_type")


def unpurchased_carts(rows: DataFrame) -> DataFrame:
    """The stream's written rows without its heartbeats."""
    return rows.where(F.col("event_type") == CART_ADDED).select("event_id", "user_id", F.col("added_at").alias("ts"))


def heartbeat(events: DataFrame, after: str) -> DataFrame:
    """One row like ``events``: a heartbeat at ``after`` beyond their newest time and sequence number."""
    newest = events.agg(F.max("ts").alias("ts"), F.max("seq").alias("seq"))
    values = {"ts": F.col("ts") + F.expr(f"INTERVAL {after}"), "seq": F.col("seq") + 1, "event_type": F.lit(HEARTBEAT)}
    return newest.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])
