"""KPI trend versus the previous period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.money import MONEY_ACC, money_sum, money_total, to_money_acc
from ..functions.text import js_fixed1
from ..schema import PAYMENT_FAILED, PURCHASE_COMPLETED, UNKNOWN
from .events import with_amount
from .timecols import truncate


def _with_trends(per_period: DataFrame, names: list[str], unit: str) -> DataFrame:
    """Adds, per KPI, the previous calendar period's value, the change in
    percent (and as text, e.g. '+12.5%') and whether it went up.

    One row per period: the window spans the (small) period table only.  The
    existing row before counts only if it is the calendar period before: after
    a gap there is nothing to compare with.  The steps are separate
    projections so each value is computed once.
    """
    prev_of = Window.orderBy("period_start")
    step = per_period.withColumn("_adjacent", F.lag("period_start").over(prev_of)
                                 == F.col("period_start") - F.expr(f"INTERVAL 1 {unit}"))
    step = step.select("period_start", *names, *[
        F.when(F.col("_adjacent"), F.lag(n).over(prev_of)).alias(f"{n}_prev") for n in names])
    step = step.select("*", *[
        F.when(F.col(f"{n}_prev").isNotNull() & (F.col(f"{n}_prev") != 0),
               (F.col(n) - F.col(f"{n}_prev")) / F.col(f"{n}_prev") * 100).alias(f"{n}_trend_pct")
        for n in names])
    cols = [F.col("period_start")]
    for n in names:
        pct = F.col(f"{n}_trend_pct")
        cols += [
            F.col(n), F.col(f"{n}_prev"), pct,
            F.when(pct.isNotNull(), F.concat(F.when(pct >= 0, F.lit("+")).otherwise(F.lit("")),
                                             js_fixed1(pct), F.lit("%"))).alias(f"{n}_trend"),
            F.when(F.col(f"{n}_prev").isNotNull(), F.col(n) >= F.col(f"{n}_prev")).alias(f"{n}_up"),
        ]
    return step.select(*cols)


def kpi_trend(events: DataFrame, unit: str = "day") -> DataFrame:
    """Revenue, orders, failed payments and distinct users per period, each
    with the previous period's value, change in percent and direction."""
    ev = with_amount(events)
    is_paid = F.col("event_type") == PURCHASE_COMPLETED
    # Two-level aggregate instead of count_distinct next to sums (which Spark
    # plans as an Expand duplicating every row): (period, user) rows first,
    # partially aggregated map-side, then one row per period.
    per_user = ev.groupBy(truncate(ev, unit).alias("period_start"),
                          F.coalesce(F.col("user_id"), F.lit(UNKNOWN)).alias("user_id")).agg(
        F.sum(F.when(is_paid, to_money_acc(F.col("amount")))).alias("acc"),
        F.count_if(F.col("event_type") == PURCHASE_COMPLETED).alias("orders"),
        F.count_if(F.col("event_type") == PAYMENT_FAILED).alias("failed_payments"),
    )
    per_period = per_user.groupBy("period_start").agg(
        money_total(F.coalesce(F.sum("acc"), F.lit(0).cast(MONEY_ACC))).alias("revenue"),
        F.sum("orders").alias("orders"),
        F.sum("failed_payments").alias("failed_payments"),
        F.count(F.lit(1)).alias("active_users"),
    )
    return _with_trends(per_period, ["revenue", "orders", "failed_payments", "active_users"], unit)


def sales_trend(sales: DataFrame, unit: str = "month") -> DataFrame:
    """Revenue and orders per period over purchase-only data (the sales view)."""
    per_period = sales.groupBy(truncate(sales, unit).alias("period_start")).agg(
        money_sum("amount").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    return _with_trends(per_period, ["revenue", "orders"], unit)


def trend_from_periods(per_period: DataFrame, unit: str = "month") -> DataFrame:
    """Trend over ready period totals ``(period_start, revenue, purchases)``."""
    return _with_trends(per_period.withColumnRenamed("purchases", "orders"), ["revenue", "orders"], unit)
