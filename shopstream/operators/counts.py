"""Single-scan conditional aggregates: counts, revenue, conversion rates.

All of A1, A3, A4, D3 and D4 come out of one aggregate over the event table;
Catalyst prunes the aggregate expressions a query does not use, and the
aggregate is computed partially on every map task, so a hot event type or
user never concentrates in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.money import money_sum
from ..schema import BREAKDOWN, CART_ADDED, CURRENCY, EVENT_TYPES, PAYMENT_FAILED, PURCHASE_COMPLETED
from .events import is_purchase, type_key, with_amount


def _count_type(name: str):
    return F.count_if(F.col("event_type") == F.lit(name)).alias(name)


def kpi_aggregates(events: DataFrame) -> DataFrame:
    """One row: the five per-type counts, total, and total revenue."""
    ev = with_amount(events)
    purchase_amount = F.when(is_purchase(), F.col("amount"))
    return ev.agg(
        *[_count_type(t) for t in EVENT_TYPES],
        F.count(F.lit(1)).alias("total"),
        money_sum(purchase_amount).alias("total_revenue"),
    )


def event_counts(events: DataFrame) -> DataFrame:
    """A3 + A4: five fixed type counts and the total of *all* events."""
    return kpi_aggregates(events).select(*EVENT_TYPES, "total")


def event_counts_dedup(events: DataFrame) -> DataFrame:
    """A3 + A4 with every ``event_id`` counted once, by its first delivery (T5).

    The type travels as a number next to ``seq`` in one long, so that the
    per-id aggregate stays a hash aggregate over fixed-width values.  Events
    without an id count one each.
    """
    code = F.coalesce(*[F.when(F.col("event_type") == t, i + 1) for i, t in enumerate(EVENT_TYPES)], F.lit(0))
    first = events.select(
        "event_id", F.when(F.col("event_id").isNull(), F.monotonically_increasing_id()).alias("row"),
        (F.coalesce("seq", F.lit(0)) * 8 + code).alias("seq_and_type"))
    kinds = (first.groupBy("event_id", "row").agg(F.min("seq_and_type").alias("s"))
             .select(F.pmod("s", F.lit(8)).alias("code")))
    return kinds.agg(*[F.count_if(F.col("code") == i + 1).alias(t) for i, t in enumerate(EVENT_TYPES)],
                     F.count(F.lit(1)).alias("total"))


def events_by_type(events: DataFrame) -> DataFrame:
    """A2: a counter per event type string, any string, 'unknown' if missing."""
    return (events.groupBy(type_key().alias("event_type"))
            .agg(F.count(F.lit(1)).alias("event_count")))


def revenue_total(events: DataFrame) -> DataFrame:
    """A1: total purchase revenue (0 when none) and the currency."""
    return kpi_aggregates(events).select("total_revenue", F.lit(CURRENCY).alias("currency"))


def cart_abandonment(events: DataFrame) -> DataFrame:
    """D3: ``1 - purchases / cart_added``; null without carts, never clamped."""
    agg = kpi_aggregates(events)
    return agg.select(
        F.col(CART_ADDED).alias("cart_added"),
        F.col(PURCHASE_COMPLETED).alias("purchases"),
        F.when(F.col(CART_ADDED) > 0,
               F.lit(1.0) - F.col(PURCHASE_COMPLETED) / F.col(CART_ADDED)).alias("abandonment_rate"),
    )


def failed_payment_rate(events: DataFrame) -> DataFrame:
    """``failed / (failed + purchases)``; null without checkout attempts."""
    agg = kpi_aggregates(events)
    attempts = F.col(PAYMENT_FAILED) + F.col(PURCHASE_COMPLETED)
    return agg.select(
        F.col(PAYMENT_FAILED).alias("payment_failed"),
        F.col(PURCHASE_COMPLETED).alias("purchases"),
        F.when(attempts > 0, F.col(PAYMENT_FAILED) / attempts).alias("failed_payment_rate"),
    )


def event_breakdown(events: DataFrame) -> DataFrame:
    """The three charted types with their display label and colour."""
    counts = event_counts(events)
    rows = ", ".join(f"'{label}', '{color}', `{etype}`" for etype, label, color in BREAKDOWN)
    return counts.selectExpr(f"stack({len(BREAKDOWN)}, {rows}) AS (name, color, value)")
