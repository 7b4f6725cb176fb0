"""Revenue: totals per time window / calendar period, running total, history.

Inputs are *purchases*: rows with ``ts``, ``amount`` (and ``seq`` /
``event_id`` for the order-dependent metrics).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.money import MONEY_ACC, money_sum, money_total, to_money_acc
from ..functions.text import clock_label
from ..schema import CURRENCY, REVENUE_HISTORY_LIMIT
from .joins import fits_broadcast, join_dimension
from .prefix import running_sums
from .timecols import truncate


def revenue_total(purchases: DataFrame) -> DataFrame:
    """A1 over purchase-only data: exact total and the currency."""
    return purchases.agg(money_sum("amount").alias("total_revenue"),
                         F.lit(CURRENCY).alias("currency"))


def revenue_by_window(purchases: DataFrame, duration: str) -> DataFrame:
    """Revenue and purchase count per tumbling event-time window."""
    return (purchases.groupBy(F.window("ts", duration).alias("w"))
            .agg(money_sum("amount").alias("revenue"), F.count(F.lit(1)).alias("purchases"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "revenue", "purchases"))


def revenue_by_period(purchases: DataFrame, unit: str) -> DataFrame:
    """Revenue per calendar period (``week`` starts Monday, ``month``, ``year``)."""
    return (purchases.groupBy(truncate(purchases, unit).alias("period_start"))
            .agg(money_sum("amount").alias("revenue"), F.count(F.lit(1)).alias("purchases")))


def revenue_by_period_via_orders(lines: DataFrame, orders: DataFrame, unit: str) -> DataFrame:
    """D7 over order lines whose date lives on the order (eager aggregation).

    When ``orders`` is too big to broadcast, lines are first summed per order
    key (map-side partial sums), so the shuffle join with ``orders`` sees one
    row per order and reuses the aggregate's hash partitioning on the key;
    periods are then summed from order rows.  A broadcastable ``orders`` is
    looked up per line.  Equal to ``revenue_by_period`` on lines joined to
    their order dates.
    """
    dates = orders.select("o_orderkey", "o_orderdate")
    if fits_broadcast(dates):
        # small order table: broadcast lookup per line, no pre-aggregation
        per_order = lines.select("l_orderkey", to_money_acc(F.col("l_extendedprice")).alias("acc"),
                                 F.lit(1).cast("bigint").alias("n"))
        dated = per_order.join(F.broadcast(dates), per_order["l_orderkey"] == dates["o_orderkey"], "left")
    else:
        per_order = (lines.groupBy("l_orderkey")
                     .agg(F.sum(to_money_acc(F.col("l_extendedprice"))).alias("acc"),
                          F.count(F.lit(1)).alias("n")))
        dated = join_dimension(per_order, dates, per_order["l_orderkey"] == dates["o_orderkey"], how="left",
                               limit=0)          # measured already
    period = truncate(dated, unit, "o_orderdate")
    return (dated.groupBy(period.alias("period_start"))
            .agg(money_total(F.coalesce(F.sum("acc"), F.lit(0).cast(MONEY_ACC))).alias("revenue"),
                 F.sum("n").alias("purchases")))


# ---------------------------------------------------------------------------
# Running total
# ---------------------------------------------------------------------------
def revenue_running(purchases: DataFrame, partitions: int | None = None) -> DataFrame:
    """Cumulative revenue after each purchase, in (ts, seq) order: a distributed prefix sum (``prefix``)."""
    base = purchases.select("seq", "event_id", "ts", F.col("amount").cast("double").alias("amount"),
                            to_money_acc(F.col("amount")).alias("acc"))
    rows = running_sums(base, ["ts", "seq"], {"cumulative": F.col("acc")}, partitions)
    return rows.select("event_id", "ts", "amount",
                       money_total(F.col("cumulative").cast(MONEY_ACC)).alias("cumulative_revenue"))


def revenue_history_rows(purchases: DataFrame, n: int = REVENUE_HISTORY_LIMIT) -> DataFrame:
    """L2 rows with their order keys: ``(seq, event_id, ts, name, revenue)``.

    Only n rows are ordered: value at row i = grand total - sum of the newer
    rows among the n (every newer purchase is one of them).
    """
    acc = to_money_acc(F.col("amount"))
    # grand total as a scalar subquery: evaluated once, used as a constant
    total = purchases.agg(F.coalesce(F.sum(acc), F.lit(0).cast(MONEY_ACC))).scalar()
    newest = (purchases.select("seq", "event_id", "ts", acc.alias("acc"))
              .orderBy(F.desc("ts"), F.desc("seq")).limit(n))
    newer = Window.orderBy(F.desc("ts"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.sum("acc").over(newer), F.lit(0).cast(MONEY_ACC))
    return newest.select(
        "seq", "event_id", "ts",
        clock_label(F.col("ts")).alias("name"),
        money_total((total - later).cast(MONEY_ACC)).alias("revenue"),
    )


def revenue_history(purchases: DataFrame, n: int = REVENUE_HISTORY_LIMIT) -> DataFrame:
    """L2: the running total at each of the n newest purchases, oldest first, HH:MM:SS labels."""
    return revenue_history_rows(purchases, n).orderBy("ts", "seq").drop("seq")
