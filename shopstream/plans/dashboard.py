"""Composite results: the KPI row (P7), its text form (P10) and the
dashboard row (C1).

Each part is its own small aggregate; parts are combined with scalar
subqueries (each evaluated once and used as a constant), so no join, let
alone a cross product, is planned.  The lists inside the dashboard are
bounded by their feature (top 10, newest 15, newest 20) and are assembled
from the map-side top-k results, never from a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import MONEY_ACC, is_readable, money_total, to_money_acc
from ..functions.text import clock_label, compact_count, currency_k, grouped_int
from ..operators.active_users import open_users, session_bounds, users_since
from ..operators.events import is_feed_event, is_purchase, purchases, with_amount
from ..operators.feed import feed_projection
from ..operators.joins import attach_by_key
from ..operators.products import product_counts_by_id, top_by_count, top_products
from ..operators.timecols import epoch_micros
from ..operators.trend import kpi_trend
from ..schema import (
    ACTIVE_GAP_SECONDS, ACTIVE_WINDOW_LABEL, BREAKDOWN, CURRENCY, EVENT_TYPES, FEED_TIME_LABEL,
    RECENT_EVENTS_LIMIT, REVENUE_HISTORY_LIMIT,
)


def _sorted_list(df: DataFrame, sort_fields: list[str], out_fields: list[str], asc: bool) -> Column:
    """A scalar subquery: the rows of a small ``df`` as an ordered array of structs."""
    keys = [F.col(f).alias(f"_k{i}") for i, f in enumerate(sort_fields)]
    packed = F.sort_array(F.collect_list(F.struct(*keys, *out_fields)), asc=asc)
    shaped = F.transform(packed, lambda x: F.struct(*[x[f].alias(f) for f in out_fields]))
    return df.agg(shaped.alias("a")).scalar()


def _kpi_row(events: DataFrame, gap_seconds: int = ACTIVE_GAP_SECONDS) -> Column:
    """A scalar struct: type counts, total, exact revenue and the bounds of the
    newest session.  One scan: an aggregate per 300 s bucket, then one row."""
    us = epoch_micros(events)
    ev = with_amount(events).withColumn("_us", us).withColumn(
        "_bucket", F.floor(us / (gap_seconds * 1_000_000)).cast("bigint"))
    amount = F.when(is_purchase(), F.col("amount"))
    buckets = ev.groupBy(F.col("_bucket").alias("bucket")).agg(
        F.min("_us").alias("lo"), F.max("_us").alias("hi"), F.count(F.lit(1)).alias("total"),
        F.sum(to_money_acc(amount)).alias("acc"),
        *[F.count_if(F.col("event_type") == t).alias(t) for t in EVENT_TYPES])
    row = session_bounds(
        buckets, gap_seconds, F.coalesce(F.sum("acc"), F.lit(0).cast(MONEY_ACC)).cast(MONEY_ACC).alias("acc"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", *EVENT_TYPES)])
    return row.select(F.struct(*row.columns)).scalar()


def kpis(events: DataFrame) -> DataFrame:
    """The four dashboard cards plus the event total, as one row; two scans."""
    row = _kpi_row(events)
    return users_since(events, row["start_us"]).select(
        money_total(row["acc"]).alias("revenue"),
        open_users(F.col("users"), row).alias("active_users"),
        row["purchase_completed"].alias("total_orders"),
        row["payment_failed"].alias("failed_payments"),
        row["total"].alias("total_events"),
    )


def kpi_text(events: DataFrame) -> DataFrame:
    """P10: the cards' display strings."""
    return kpis(events).select(
        currency_k(F.col("revenue")).alias("revenue_text"),
        grouped_int(F.col("active_users")).alias("active_users_text"),
        grouped_int(F.col("total_orders")).alias("total_orders_text"),
        grouped_int(F.col("failed_payments")).alias("failed_payments_text"),
        compact_count(F.col("total_events")).alias("total_events_text"),
    )


def _newest_lists(events: DataFrame, names: DataFrame | None, total: Column) -> Column:
    """A scalar struct: ``recent`` (newest feed rows, newest first) and
    ``history`` (running total at the newest purchases, oldest first).

    Both lists come from one scan: a row that belongs to both appears twice,
    ranked per list, and only each list's newest rows leave a map task.
    """
    ev = with_amount(events)
    paid = is_purchase() & is_readable(F.col("amount"))
    lists = F.array_compact(F.array(
        F.when(is_feed_event() & (~is_purchase() | paid), F.lit("recent")), F.when(paid, F.lit("history"))))
    ranked = ev.withColumn("_list", F.explode(lists)).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_list").orderBy(F.desc("ts"), F.desc("seq"))))
    ranked = ranked.where(F.col("_rank") <= max(RECENT_EVENTS_LIMIT, REVENUE_HISTORY_LIMIT))
    if names is not None:
        ranked = attach_by_key(ranked.drop("product_name"), names, "product_id", "p_partkey", ["p_name"])
        ranked = ranked.withColumnRenamed("p_name", "product_name")
    newer = Window.partitionBy("_list").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.sum(to_money_acc(F.col("amount"))).over(newer), F.lit(0).cast(MONEY_ACC))
    rows = ranked.withColumn("revenue", money_total((total - later).cast(MONEY_ACC))).withColumn(
        "name", clock_label(F.col("ts")))
    keep = ["_list", "_rank", "revenue", "name"]
    rows = feed_projection(rows, keep).withColumn("time", F.lit(FEED_TIME_LABEL))

    def packed(which: str, limit: int, fields: list[str], newest_first: bool) -> Column:
        chosen = F.when((F.col("_list") == which) & (F.col("_rank") <= limit), F.struct("_rank", *fields))
        return F.transform(F.sort_array(F.collect_list(chosen), asc=newest_first),
                           lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(which)

    return rows.agg(F.struct(
        packed("recent", RECENT_EVENTS_LIMIT, ["id", "type", "title", "subtitle", "time"], True),
        packed("history", REVENUE_HISTORY_LIMIT, ["name", "revenue"], False)).alias("s")).scalar()


def dashboard(events: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Revenue, top products, counts, active users, feed, history - one row.

    Four scans of the events: KPIs with session bounds, users of the open
    session, product counts, and both newest-first lists.  With ``names``
    (``part``), ``events`` need no product names: products are counted per id
    and named once per product, and only the listed rows are named; where
    ``names`` is too large to broadcast, their keys are a fifth scan.
    """
    row = _kpi_row(events)
    paid = purchases(events)
    ranked = (top_products(paid) if names is None
              else top_by_count(product_counts_by_id(paid, names)))
    top = _sorted_list(ranked, ["purchase_count", "product_name"],
                       ["product_name", "purchase_count"], asc=False)
    lists = _newest_lists(events, names, row["acc"])
    return users_since(events, row["start_us"]).select(
        F.struct(money_total(row["acc"]).alias("total_revenue"), F.lit(CURRENCY).alias("currency")).alias("revenue"),
        F.struct(top.alias("products")).alias("top_products"),
        F.struct(*[row[t].alias(t) for t in EVENT_TYPES], row["total"].alias("total")).alias("event_counts"),
        F.struct(open_users(F.col("users"), row).alias("active_users"), F.lit(ACTIVE_WINDOW_LABEL).alias("window"))
        .alias("active_users"),
        lists["recent"].alias("recent_events"),
        lists["history"].alias("revenue_history"),
    )


def dashboard_json(events: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The dashboard row as one JSON document (the export payload)."""
    row = dashboard(events, names)
    return row.select(F.to_json(F.struct(*row.columns)).alias("dashboard"))


def dashboard_payload(events: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The documented payload in one row: ``kpis`` (title, value, trend, trendUp,
    subtitle), ``charts`` (revenue, topProducts, eventBreakdown), ``liveEvents``.

    Trends compare the newest day with the calendar day before it.
    """
    newest = kpi_trend(events, "day").orderBy(F.desc("period_start")).limit(1)
    row = dashboard(events, names).withColumn("_t", newest.select(F.struct("*").alias("t")).scalar())
    board, t = {c: F.col(c) for c in row.columns}, F.col("_t")
    counts = board["event_counts"]
    cards = [("Total Revenue", currency_k(board["revenue"]["total_revenue"]), "revenue"),
             ("Active Users", grouped_int(board["active_users"]["active_users"]), "active_users"),
             ("Total Orders", grouped_int(counts["purchase_completed"]), "orders"),
             ("Failed Payments", grouped_int(counts["payment_failed"]), "failed_payments")]
    products = board["top_products"]["products"]
    best = F.greatest(F.array_max(F.transform(products, lambda p: p["purchase_count"])), F.lit(1))
    return row.select(
        F.array(*[F.struct(F.lit(title).alias("title"), value.alias("value"), t[f"{name}_trend"].alias("trend"),
                           t[f"{name}_up"].alias("trendUp"), F.lit("vs previous day").alias("subtitle"))
                  for title, value, name in cards]).alias("kpis"),
        F.struct(
            board["revenue_history"].alias("revenue"),
            F.transform(products, lambda p: F.struct(
                p["product_name"].alias("name"), p["purchase_count"].alias("sales"),
                (p["purchase_count"] / best * 100).alias("percent"))).alias("topProducts"),
            F.array(*[F.struct(F.lit(label).alias("name"), counts[kind].alias("value"), F.lit(color).alias("color"))
                      for kind, label, color in BREAKDOWN]).alias("eventBreakdown")).alias("charts"),
        board["recent_events"].alias("liveEvents"))
