"""The dashboard as it stood at the end of every hour, in one job (C1 at many times).

No state is looked up per ``as_of``.  Events are reduced once per slot (an hour); what a dashboard needs from
all earlier time is a prefix of the slots:

* revenue and counts: prefix sums over the slots (``prefix.running_sums``);
* the newest purchases and feed rows: a slot keeps its own newest 20 and 15, numbered by the prefix counts.
  The list at a slot's end is the last 20 (15) numbers up to its count, an equi-join on the number;
* the best products: see ``best_products``;
* active users: users by the slot of their first event in a session, summed up inside the session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import MONEY_ACC, is_readable, money_total, to_money_acc
from ..functions.text import clock_label
from ..operators.active_users import session_users
from ..operators.events import is_feed_event, is_purchase, with_amount
from ..operators.feed import feed_projection
from ..operators.joins import join_dimension
from ..operators.prefix import running_sums
from ..operators.timecols import epoch_micros, from_micros
from ..schema import (
    ACTIVE_GAP_SECONDS, ACTIVE_WINDOW_LABEL, CURRENCY, EVENT_TYPES, FEED_TIME_LABEL, RECENT_EVENTS_LIMIT,
    REVENUE_HISTORY_LIMIT, TOP_PRODUCTS_LIMIT, UNKNOWN,
)
from ..session import ensure_checkpoint_dir

SLOT_SECONDS = 3600
CHUNKS = 64                  # ranges of slots whose starting counts are known for every product


def _paid() -> Column:
    return is_purchase() & is_readable(F.col("amount"))


def _feed() -> Column:
    return is_feed_event() & (~is_purchase() | is_readable(F.col("amount")))


def slot_totals(events: DataFrame) -> DataFrame:
    """Per slot from the first to the last: running revenue (acc), event counts, purchases and feed rows."""
    acc = F.when(is_purchase(), to_money_acc(F.col("amount")))
    own = events.groupBy("slot").agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(acc), F.lit(0).cast(MONEY_ACC)).cast(MONEY_ACC).alias("acc"),
        F.count_if(_paid()).alias("paid"), F.count_if(_feed()).alias("feed"),
        *[F.count_if(F.col("event_type") == t).alias(t) for t in EVENT_TYPES]).checkpoint(eager=True)
    names = [c for c in own.columns if c != "slot"]
    every = own.agg(F.explode(F.sequence(F.min("slot"), F.max("slot"))).alias("at")) if own.head(1) else \
        own.select(F.col("slot").alias("at"))
    dense = every.join(own, F.col("at") == F.col("slot"), "left").select(
        F.col("at").alias("slot"), *[F.col(c).alias(f"_own_{c}") for c in names])
    return running_sums(dense, ["slot"], {c: F.coalesce(F.col(f"_own_{c}"), F.lit(0)) for c in names}).select(
        "slot", *[F.col(c).cast(MONEY_ACC if c == "acc" else "bigint").alias(c) for c in names])


def _numbered(events: DataFrame, totals: DataFrame, names: DataFrame) -> DataFrame:
    """The newest rows of each slot and list, with their number in the whole list and the running revenue."""
    lists = F.array_compact(F.array(F.when(_feed(), F.lit("feed")), F.when(_paid(), F.lit("paid"))))
    newest = Window.partitionBy("slot", "_list").orderBy(F.desc("ts"), F.desc("seq"))
    ranked = (events.withColumn("_list", F.explode(lists)).withColumn("_rank", F.row_number().over(newest))
              .where(F.col("_rank") <= F.when(F.col("_list") == "feed", RECENT_EVENTS_LIMIT).otherwise(REVENUE_HISTORY_LIMIT)))
    newer = Window.partitionBy("slot", "_list").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_later", F.coalesce(F.sum(to_money_acc(F.col("amount"))).over(newer), F.lit(0)))
    at = totals.select(F.col("slot").alias("_slot"), F.col("acc").alias("_acc"),
                       F.create_map(F.lit("feed"), "feed", F.lit("paid"), "paid").alias("_n"))
    ranked = ranked.join(at, F.col("slot") == F.col("_slot"))
    dims = names.select(F.col("p_partkey").alias("_key"), F.col("p_name").alias("_name"))
    keyed = ranked.withColumn("_pid", F.col("product_id").try_cast(dims.schema["_key"].dataType))
    named = (join_dimension(keyed, dims, keyed["_pid"] == dims["_key"], how="left")
             .drop("product_name").withColumnRenamed("_name", "product_name"))
    rows = named.withColumns({"number": F.col("_n")[F.col("_list")] - F.col("_rank") + 1, "name": clock_label(F.col("ts")),
                              "revenue": money_total((F.col("_acc") - F.col("_later")).cast(MONEY_ACC))})
    return feed_projection(rows, ["_list", "number", "name", "revenue"]).withColumn("time", F.lit(FEED_TIME_LABEL))


def newest_lists(events: DataFrame, totals: DataFrame, names: DataFrame) -> DataFrame:
    """slot, recent_events (newest first), revenue_history (oldest first)."""
    rows = _numbered(events, totals, names).checkpoint(eager=True)       # 35 a slot at most

    def wanted(which: str, limit: int, fields: list[str], asc: bool, out: str) -> DataFrame:
        first = F.greatest(F.col(which) - (limit - 1), F.lit(1).cast("bigint"))
        numbers = totals.where(F.col(which) > 0).select(F.col("slot").alias(f"_{out}"), F.explode(F.sequence(first, F.col(which))).alias("_no"))
        chosen = rows.where(F.col("_list") == which).join(numbers, F.col("number") == F.col("_no"))
        packed = F.sort_array(F.collect_list(F.struct("number", *fields)), asc=asc)      # ``limit`` rows
        return chosen.groupBy(f"_{out}").agg(F.transform(packed, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(out))

    recent = wanted("feed", RECENT_EVENTS_LIMIT, ["id", "type", "title", "subtitle", "time"], False, "recent_events")
    history = wanted("paid", REVENUE_HISTORY_LIMIT, ["name", "revenue"], True, "revenue_history")
    return (totals.select("slot").join(recent, F.col("slot") == F.col("_recent_events"), "left")
            .join(history, F.col("slot") == F.col("_revenue_history"), "left")
            .select("slot", "recent_events", "revenue_history"))


def best_products(events: DataFrame, totals: DataFrame, names: DataFrame, n: int = TOP_PRODUCTS_LIMIT) -> DataFrame:
    """slot, products: the ``n`` names with most purchases up to the slot's end.

    Counts only grow, so the n-th best count does too.  The slots are cut into ``CHUNKS`` ranges; for each, every
    product's count at its start and end is known (a prefix over at most ``CHUNKS`` rows a product).  A product
    whose count at a range's end is below the n-th best at its start can't be listed inside the range; only the
    others are followed slot by slot.
    """
    per_id = events.where(_paid()).groupBy("slot", F.col("product_id").alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    dims = names.select(F.col("p_partkey").alias("_key"), F.col("p_name").alias("_name"))
    keyed = per_id.withColumn("_id", F.col("_pid").try_cast(dims.schema["_key"].dataType))
    sold = (join_dimension(keyed, dims, keyed["_id"] == dims["_key"], how="left")
            .groupBy("slot", F.coalesce("_name", F.lit(UNKNOWN)).alias("product_name")).agg(F.sum("_n").alias("n"))
            .checkpoint(eager=True))
    bounds = totals.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).first()
    lo, hi = bounds["lo"] or 0, bounds["hi"] or 0
    size = -(-(hi - lo + 1) // CHUNKS)
    last = (hi - lo) // size

    per_chunk = sold.groupBy("product_name", F.floor((F.col("slot") - lo) / size).cast("bigint").alias("chunk")).agg(F.sum("n").alias("n"))
    in_time = Window.partitionBy("product_name").orderBy("chunk")
    until = F.coalesce(F.lead("chunk").over(in_time) - 1, F.lit(last).cast("bigint"))
    dense = (per_chunk.withColumn("upto", F.sum("n").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("until", until).withColumn("k", F.explode(F.sequence("chunk", "until")))
             .select("product_name", "k", "upto", (F.col("upto") - F.when(F.col("k") == F.col("chunk"), F.col("n")).otherwise(0)).alias("start")))
    ahead = Window.partitionBy("k").orderBy(F.desc("start"), F.desc("product_name"))
    least = (dense.withColumn("_r", F.row_number().over(ahead)).where(F.col("_r") <= n).groupBy(F.col("k").alias("_k"))
             .agg(F.when(F.count(F.lit(1)) == n, F.min("start")).otherwise(0).alias("least")))
    follow = dense.join(F.broadcast(least), F.col("k") == F.col("_k")).where("upto >= least")     # CHUNKS rows
    first = F.lit(lo) + F.col("k") * size
    steps = follow.withColumn("at", F.explode(F.sequence(first, F.least(first + size - 1, F.lit(hi)))))
    own = sold.select(F.col("slot").alias("_slot"), F.col("product_name").alias("_name"), "n")
    steps = steps.join(own, (F.col("at") == F.col("_slot")) & (F.col("product_name") == F.col("_name")), "left")
    inside = Window.partitionBy("k", "product_name").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("purchase_count", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    best = Window.partitionBy("at").orderBy(F.desc("purchase_count"), F.desc("product_name"))
    top = steps.where("purchase_count > 0").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n)
    packed = F.sort_array(F.collect_list(F.struct("_r", "product_name", F.col("purchase_count").cast("bigint").alias("purchase_count"))))
    return top.groupBy(F.col("at").alias("slot")).agg(F.transform(packed, lambda x: F.struct(
        x["product_name"].alias("product_name"), x["purchase_count"].alias("purchase_count"))).alias("products"))


def users_by_slot(events: DataFrame, slot_us: int, gap_seconds: int = ACTIVE_GAP_SECONDS) -> DataFrame:
    """slot, users: distinct users so far of the session open at the slot's end; no row where none is open."""
    users = session_users(events, gap_seconds)
    firsts = users.select("session_us", epoch_micros(users, "first_ts").alias("first"), epoch_micros(users, "last_ts").alias("last"))
    spans = firsts.groupBy("session_us").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    start = F.floor(F.col("first") / slot_us).cast("bigint")
    # open at a slot's end while that is less than the gap after the last event
    end = F.floor((F.col("last") + gap_seconds * 1_000_000 - 1) / slot_us).cast("bigint") - 1
    covered = spans.where(end >= start).select(F.col("session_us").alias("_s"), F.explode(F.sequence(start, end)).alias("at"))
    new = firsts.groupBy("session_us", F.floor(F.col("first") / slot_us).cast("bigint").alias("slot")).agg(F.count(F.lit(1)).alias("new"))
    rows = covered.join(new, (F.col("_s") == F.col("session_us")) & (F.col("at") == F.col("slot")), "left")
    so_far = Window.partitionBy("_s").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(F.col("at").alias("slot"), F.sum("new").over(so_far).alias("users"))


def dashboard_timeline(events: DataFrame, names: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """C1 at the end of every slot from the first event's to the last's: ``as_of`` and the dashboard's columns.

    A dashboard shows the events before its ``as_of``; events without a time are in none.
    """
    ensure_checkpoint_dir(events.sparkSession)
    slot_us = slot_seconds * 1_000_000
    ev = with_amount(events.where("ts IS NOT NULL")).withColumn("slot", F.floor(epoch_micros(events) / slot_us).cast("bigint"))
    totals = slot_totals(ev).checkpoint(eager=True)                       # a row per slot
    lists = newest_lists(ev, totals, names)
    top = best_products(ev, totals, names)
    users = users_by_slot(events.where("ts IS NOT NULL"), slot_us)

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.withColumnRenamed("slot", name)

    rows = totals
    for i, df in enumerate((lists, top, users)):
        rows = rows.join(part(df, f"_at{i}"), F.col("slot") == F.col(f"_at{i}"), "left")

    def listed(column: str, df: DataFrame) -> Column:
        return F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType))

    return rows.select(
        from_micros(events, (F.col("slot") + 1) * slot_us).alias("as_of"),
        F.struct(money_total(F.col("acc")).alias("total_revenue"), F.lit(CURRENCY).alias("currency")).alias("revenue"),
        F.struct(listed("products", top).alias("products")).alias("top_products"),
        F.struct(*EVENT_TYPES, "total").alias("event_counts"),
        F.struct(F.coalesce("users", F.lit(0)).cast("bigint").alias("active_users"), F.lit(ACTIVE_WINDOW_LABEL).alias("window")).alias("active_users"),
        listed("recent_events", lists).alias("recent_events"),
        listed("revenue_history", lists).alias("revenue_history"))
