"""Row-level building blocks over canonical events (projections, predicates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import is_readable, purchase_amount
from ..schema import FEED_KINDS, PURCHASE_COMPLETED, UNKNOWN


def type_key(col: Column | str = "event_type") -> Column:
    """Event type as counted: a missing type counts as 'unknown'."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, F.lit(UNKNOWN))


def product_key(col: Column | str = "product_name") -> Column:
    """Product as ranked: keyed by name, 'unknown' when missing."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, F.lit(UNKNOWN))


def is_purchase(col: Column | str = "event_type") -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col == F.lit(PURCHASE_COMPLETED)


def is_feed_event(col: Column | str = "event_type") -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.isin(*FEED_KINDS)


def dedupe_events(events: DataFrame) -> DataFrame:
    """Opt-in: keep one event per ``event_id`` (by default every delivery counts,
    as in the reference's at-least-once consumer).

    The delivery with the lowest ``seq`` stays.  Events without an id are
    different events: none of them is dropped.  An aggregate on the id with
    map-side partial de-duplication, so an id delivered many times collapses
    before the shuffle; id-less rows are keyed by row, never gathered.
    """
    others = [c for c in events.columns if c not in ("event_id", "seq")]
    keyed = events.withColumn(
        "_row", F.when(F.col("event_id").isNull(), F.monotonically_increasing_id()))
    # a map can't be ordered: it rides along as the value of min_by
    kept = keyed.groupBy("event_id", "_row").agg(
        F.min("seq").alias("seq"),
        F.min_by(F.struct(*others), F.struct(F.coalesce("seq", F.lit(-1)), *[
            c for c in others if not events.schema[c].dataType.typeName() == "map"])).alias("_e"))
    return kept.select(*[F.col(c) if c in ("event_id", "seq") else F.col(f"_e.{c}") for c in events.columns])


def with_amount(events: DataFrame) -> DataFrame:
    """Adds ``amount = price * quantity``; null when price or quantity is unreadable.

    NaN, infinite and boundless amounts stay visible here, but no metric adds
    them up (``functions.money.is_readable``).
    """
    return events.withColumn("amount", purchase_amount("price", "quantity"))


def purchases(events: DataFrame) -> DataFrame:
    """Purchases whose amount could be computed (P1 + F1).

    A purchase with an unreadable price or quantity still counts as an event,
    but adds nothing to revenue, products, history or the feed.
    """
    return (with_amount(events)
            .where(is_purchase() & is_readable(F.col("amount"))))


def feed_candidates(events: DataFrame) -> DataFrame:
    """Feed-worthy events (F2), minus purchases without a readable amount."""
    ev = with_amount(events)
    return ev.where(is_feed_event() & (~is_purchase() | is_readable(F.col("amount"))))
