"""Plan-shape checks for the scale properties the design relies on."""

from conftest import SF_SMALL

from pyspark.sql import functions as F

import __spark_entry__ as entry
from shopstream.operators.active_users import session_users
from shopstream.operators.joins import estimated_bytes, fits_broadcast, is_stored, join_dimension, stored_bytes
from shopstream.sources.adapters import shop_events
from shopstream.sources.tables import read_table


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_size_estimate_and_broadcast_check(spark):
    part = read_table(spark, SF_SMALL, "part").select("p_partkey", "p_name")
    size = estimated_bytes(part)
    assert isinstance(size, int) and size > 0
    assert fits_broadcast(part)
    assert not fits_broadcast(part, limit=1)


def test_scans_are_pruned_and_filtered(spark):
    q = entry.queries()
    counts_plan = plan_of(q["event_counts"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_type:string>" in counts_plan
    rev_plan = plan_of(q["revenue_per_minute"](spark, SF_SMALL))
    assert "In(event_type, [purchase,purchase_completed])" in rev_plan
    assert "p_name" not in rev_plan            # no name join for a revenue metric


def test_top_k_is_not_a_global_sort(spark):
    q = entry.queries()
    for name in ("top_products", "recent_events", "revenue_history", "sales_top_products"):
        plan = plan_of(q[name](spark, SF_SMALL))
        assert "TakeOrderedAndProject" in plan, name


def test_running_total_windows_only_the_partition_totals(spark):
    df = entry.queries()["revenue_running"](spark, SF_SMALL)
    df.collect()
    plan = plan_of(df)
    assert "ExistingRDD" in plan                      # rows come from the checkpoint
    window_input = plan.split("Window")[1]
    assert "keys=[part#" in window_input              # the window sees one row per partition


def test_composites_use_no_cartesian_product(spark):
    q = entry.queries()
    for name in ("dashboard", "kpis", "kpi_text", "revenue_history"):
        plan = plan_of(q[name](spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_hot_keys_are_pre_aggregated_before_the_shuffle(spark):
    """A product, type, user or window holding a third of all rows must reach
    the shuffle as one partial row per map task, not as its raw rows."""
    q = entry.queries()
    for name in ("product_counts", "events_by_type", "active_users_sliding", "event_counts_dedup",
                 "active_user_sessions", "sales_revenue_by_month"):
        plan = plan_of(q[name](spark, SF_SMALL))
        deepest = plan.rfind("Exchange hashpartitioning")
        assert deepest != -1, name
        map_side = plan[deepest:]                           # the operators feeding the first shuffle
        assert "HashAggregate(keys=" in map_side or "SortAggregate(key=" in map_side, name


def plans_of(df) -> str:
    """The plan after the run, subqueries included."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def crowded_tables(spark, folder, parts=60_000):
    """Tables whose ``part`` has few names: a few bytes a row in the file, 49 and more in memory."""
    part = spark.range(parts).select(F.col("id").alias("p_partkey"), F.concat(F.lit("name "), (F.col("id") % 40).cast("string")).alias("p_name"),
                                     F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    part.coalesce(1).write.parquet(f"{folder}/part.parquet")
    kind = F.element_at(F.array(*map(F.lit, ("view", "click", "signup", "purchase", "error"))), (F.col("id") % 5 + 1).cast("int"))
    time = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 40).cast("timestamp_ntz")
    key = F.when(F.col("id") % 11 == 3, parts + F.col("id")).otherwise(F.col("id") * 7919 % parts)      # some name no part
    events = spark.range(3_000).select(F.col("id").alias("event_id"), time.alias("ts"), (F.col("id") % 30).alias("user_id"), kind.alias("event_type"),
                                       (F.col("id") % 97 / 4).alias("value"), F.concat(F.lit('{"k": '), key.cast("string"), F.lit("}")).alias("props"))
    events.write.parquet(f"{folder}/events.parquet")
    return folder


def test_a_dimension_is_broadcast_by_its_rows_not_by_its_files(spark, scratch):
    """Small files of many rows: with them broadcast, the driver had no memory for ``dashboard_json``."""
    tables = crowded_tables(spark, scratch)
    part = read_table(spark, tables, "part").select("p_partkey", "p_name")
    queries = entry.queries()
    small = queries["dashboard_json"](spark, tables)
    assert "SortMergeJoin" not in plans_of(small)
    spark.conf.set("shopstream.broadcast.maxBytes", "1000000")
    try:
        assert estimated_bytes(part) <= 1_000_000 < stored_bytes(part)
        assert not fits_broadcast(part)
        large = queries["dashboard_json"](spark, tables)
        plan = plans_of(large)
        assert "SortMergeJoin" in plan and "LeftSemi, BuildRight" in plan   # counted ids meet part in a shuffle, listed keys go to it
        assert large.collect() == small.collect()
        named = shop_events(spark, tables)
        assert "SortMergeJoin" in plan_of(named) and "BroadcastHashJoin" not in plan_of(named)
    finally:
        spark.conf.unset("shopstream.broadcast.maxBytes")


def test_rows_are_measured_with_their_texts(spark, scratch):
    spark.createDataFrame([(1, "abc", b"12"), (2, None, None), (3, "\u20b9", b"1")], "k long, t string, b binary").write.parquet(f"{scratch}/t")
    df = spark.read.parquet(f"{scratch}/t")
    assert stored_bytes(df) == 3 * 8 * (3 + 3) + 3 + 3 + 2 + 1
    assert stored_bytes(df.where("k > 5")) == 0
    assert stored_bytes(df.select(F.array("t", "t").alias("a"))) > 0


def test_only_stored_tables_are_measured(spark):
    events = shop_events(spark, SF_SMALL, with_names=False)
    assert is_stored(events) and is_stored(events.where("seq > 5").select("seq"))
    assert not is_stored(events.groupBy("user_id").count())
    assert not is_stored(events.join(events.select("seq"), "seq"))
    tracker, group = spark.sparkContext.statusTracker(), "sessions"
    spark.sparkContext.setJobGroup(group, group)
    try:
        session_users(events)                              # its dimension is an aggregate of the events
        assert len(tracker.getJobIdsForGroup(group)) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_large_dimension_is_not_broadcast_by_the_planner(spark):
    part = read_table(spark, SF_SMALL, "part").select("p_partkey", "p_name")
    events = shop_events(spark, SF_SMALL, with_names=False).withColumn("k", F.col("product_id").cast("bigint"))
    on = events["k"] == part["p_partkey"]
    assert "BroadcastHashJoin" in plan_of(join_dimension(events, part, on))
    assert "BroadcastHashJoin" not in plan_of(join_dimension(events, part, on, limit=0))
