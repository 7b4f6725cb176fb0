"""Live feed: the newest feed-worthy events rendered as display rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import age_label, with_py_float_text
from ..schema import (
    CART_ADDED, CURRENCY_SIGN, FEED_DEFAULT_NAME, FEED_ERROR_SUBTITLE, FEED_KINDS,
    FEED_TIME_LABEL, PURCHASE_COMPLETED, RECENT_EVENTS_LIMIT, UNKNOWN,
)
from .events import feed_candidates
from .joins import attach_by_key


def _by_type(values: dict[str, str]) -> Column:
    out = None
    for etype, value in values.items():
        cond = F.col("event_type") == F.lit(etype)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out


def feed_projection(events_with_amount: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """P2 + P3: ``(id, type, title, subtitle)`` plus ``ts`` / ``seq`` for ordering and ``keep``.

    A purchase subtitle prints the amount the way Python prints a float.
    """
    name = F.coalesce(F.col("product_name"), F.lit(FEED_DEFAULT_NAME))
    events_with_amount = with_py_float_text(events_with_amount, "amount", "_amount_text")
    subtitle = (F.when(F.col("event_type") == PURCHASE_COMPLETED,
                       F.concat(name, F.lit(f" - {CURRENCY_SIGN}"), F.col("_amount_text")))
                .when(F.col("event_type") == CART_ADDED, name)
                .otherwise(F.lit(FEED_ERROR_SUBTITLE)))
    return events_with_amount.select(
        F.coalesce(F.col("event_id"), F.lit(UNKNOWN)).alias("id"),
        _by_type({t: kind for t, (kind, _) in FEED_KINDS.items()}).alias("type"),
        _by_type({t: title for t, (_, title) in FEED_KINDS.items()}).alias("title"),
        subtitle.alias("subtitle"),
        "ts", "seq", *(keep or []),
    )


def newest_feed_events(events: DataFrame, n: int = RECENT_EVENTS_LIMIT,
                       names: DataFrame | None = None) -> DataFrame:
    """The n newest feed candidates by (ts, seq) - a map-side top-k.

    With ``names`` (a ``part``-like table), events come without names and
    only the n chosen rows are named afterwards (see ``attach_by_key``).
    """
    newest = feed_candidates(events).orderBy(F.desc("ts"), F.desc("seq")).limit(n)
    if names is None:
        return newest
    named = attach_by_key(newest.drop("product_name"), names, "product_id", "p_partkey", ["p_name"])
    return named.withColumnRenamed("p_name", "product_name")


def recent_events(events: DataFrame, n: int = RECENT_EVENTS_LIMIT,
                  names: DataFrame | None = None) -> DataFrame:
    """L3: the live feed, newest first, ``time`` = 'Just now' as the reference sends."""
    return (feed_projection(newest_feed_events(events, n, names))
            .select("id", "type", "title", "subtitle", F.lit(FEED_TIME_LABEL).alias("time"), "ts"))


def feed_age(events: DataFrame, n: int = RECENT_EVENTS_LIMIT, as_of=None,
             names: DataFrame | None = None) -> DataFrame:
    """P5 (documented form): the feed with a relative age label from ``as_of``
    (default: the newest event time, as a scalar subquery)."""
    now = F.lit(as_of) if as_of is not None else events.agg(F.max("ts")).scalar()
    return (feed_projection(newest_feed_events(events, n, names))
            .select("id", "type", "title", "subtitle", age_label(F.col("ts"), now).alias("time"), "ts"))
