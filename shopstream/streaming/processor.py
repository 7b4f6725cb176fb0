"""The streaming processor.

One Structured Streaming query reads JSON events, decodes them leniently and,
per micro-batch, merges the batch's partial aggregates into the previous
*snapshot* of the state, writing the next snapshot under ``v=<batch id>``:

    counts/   (event_type, n)            A2-A4
    products/ (product_name, n)          A5 (top-k read at query time)
    totals/   one row: revenue, event total, open global session bounds
    users/    members of the open session A6 (nobody else is kept)
    sessions/ sessions closed by the batch A6 history (append-like, per version)
    history/  <= 20 rows                 L2
    feed/     <= 15 rows                 L3
    rejects/  non-JSON messages          T7 (dead letter, per batch)
    ids/      event ids first seen by the batch, with ``dedup`` (T5)

A replayed batch id rewrites the same version, so a restart after a failure
never counts an event twice (the reference's at-least-once consumer does).
Two versions of a snapshot table are kept.  Every merge is a small DataFrame
job: union with the previous snapshot and re-aggregate; nothing is collected
to the driver.

Arrival order: rows carry when and from where they arrived (Kafka timestamp,
partition and offset; or a file's time, name and the row's place in it).
Within the lists it decides between equal event times, and the arrival time
stands in for a missing event time.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.money import MONEY_ACC, money_total, to_money_acc
from ..functions.text import clock_label
from ..operators.active_users import session_users
from ..operators.events import purchases, type_key, with_amount
from ..operators.feed import feed_projection, newest_feed_events
from ..operators.products import product_key
from ..schema import (
    ACTIVE_GAP_SECONDS, ACTIVE_WINDOW_LABEL, CURRENCY, EVENT_TYPES, FEED_TIME_LABEL,
    RECENT_EVENTS_LIMIT, REVENUE_HISTORY_LIMIT, TOP_PRODUCTS_LIMIT,
)
from ..sources.json_events import (
    ARRIVAL, decode, lenient_from_decoded, lenient_rejects, rejects_from_decoded, with_arrival,
)

SNAPSHOTS = ("counts", "products", "totals", "users", "history", "feed")
TABLES = (*SNAPSHOTS, "sessions")
VERSIONS_KEPT = 2
_ARRIVAL_SCHEMA = "struct<batch_id: bigint, arrived: timestamp, arrived_from: string, arrived_at: bigint>"


def _path(state_dir: str, table: str, version: int) -> str:
    return os.path.join(state_dir, table, f"v={version}")


def _previous(spark: SparkSession, state_dir: str, table: str, version: int, schema: str) -> DataFrame:
    if version < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_path(state_dir, table, version))


_SCHEMAS = {
    "counts": "event_type string, n bigint",
    "products": "product_name string, n bigint",
    "totals": f"revenue_acc {MONEY_ACC}, events bigint, session_start timestamp_ntz, "
              "last_ts timestamp_ntz, session_events bigint",
    "users": "user_id string",
    # own amounts; the running totals follow from the grand total when read
    "history": f"ts timestamp_ntz, seq {_ARRIVAL_SCHEMA}, name string, acc {MONEY_ACC}",
    "feed": f"ts timestamp_ntz, seq {_ARRIVAL_SCHEMA}, id string, type string, "
            "title string, subtitle string, time string",
    # sessions closed by this batch only (the history is the union of versions)
    "sessions": "session_start timestamp_ntz, session_end timestamp_ntz, active_users bigint, events bigint",
    "ids": "event_id string",
}


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def _check_marks(spark: SparkSession, state_dir: str, batch_id: int, marker: str) -> None:
    """A batch must follow the state it finds: a new checkpoint on old state would start from nothing."""
    if batch_id == 0 and _exists(spark, _path(state_dir, marker, 1)):
        raise ValueError(f"{state_dir} holds the state of another checkpoint; use a new state folder")
    if batch_id > 0 and not _exists(spark, _path(state_dir, marker, batch_id - 1)):
        raise ValueError(f"{state_dir} has no version {batch_id - 1}; state and checkpoint don't belong together")


def _check_state(spark: SparkSession, state_dir: str, batch_id: int) -> None:
    _check_marks(spark, state_dir, batch_id, "totals")


def drop_version(spark: SparkSession, state_dir: str, table: str, version: int) -> None:
    """Remove a version of a state table that no later batch reads."""
    if version >= 0:
        fs, at = _files(spark, _path(state_dir, table, version))
        fs.delete(at, True)


def _drop_old_versions(spark: SparkSession, state_dir: str, batch_id: int) -> None:
    old = batch_id - VERSIONS_KEPT
    for table in SNAPSHOTS:
        # the marker of version 1 stays: it tells a new checkpoint that this state is in use
        if not (table == "totals" and old == 1):
            drop_version(spark, state_dir, table, old)


def _sessions_after(per_user: DataFrame, prev: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(sessions, members) after a batch: the carried open session and the
    batch's own ones, merged where they are less than the gap apart.

    Sessions: ``(session, start, last, events, open)``, of which the newest is
    open.  Members: ``(session, user_id)``.  A late event widens the session
    it falls into and never moves an end backwards.  The ordered window runs
    over one row per session of the batch.
    """
    gap = F.expr(f"INTERVAL {ACTIVE_GAP_SECONDS} SECONDS")
    own = per_user.groupBy("session_us").agg(
        F.min("first_ts").alias("start"), F.max("last_ts").alias("last"), F.sum("n").alias("events"))
    carried = prev["totals"].where("session_start IS NOT NULL").select(
        F.lit(None).cast("bigint").alias("session_us"), F.col("session_start").alias("start"),
        F.col("last_ts").alias("last"), F.col("session_events").alias("events"))
    in_time = Window.orderBy("start", "last", "session_us")
    before = F.max("last").over(in_time.rowsBetween(Window.unboundedPreceding, -1))
    parts = own.unionByName(carried).withColumn(
        "begins", F.when(before.isNull() | (F.col("start") >= before + gap), 1).otherwise(0))
    parts = parts.withColumn("session", F.sum("begins").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    sessions = parts.groupBy("session").agg(
        F.min("start").alias("start"), F.max("last").alias("last"), F.sum("events").alias("events"))
    sessions = sessions.withColumn("open", F.col("session") == F.max("session").over(Window.partitionBy()))
    which = parts.select(F.col("session_us").alias("_us"), "session")
    members = per_user.join(which, F.col("session_us") == F.col("_us")).select("session", "user_id")
    old = which.where("_us IS NULL").select("session")
    members = members.unionByName(prev["users"].join(F.broadcast(old), F.lit(True)).select("session", "user_id"))
    return sessions, members.distinct()


def merge_batch(events: DataFrame, batch_id: int, state_dir: str) -> None:
    """Fold one micro-batch of canonical events into the next state snapshot."""
    spark = events.sparkSession
    if "arrived_at" not in events.columns:
        events = with_arrival(events)
    _check_state(spark, state_dir, batch_id)
    prev = {t: _previous(spark, state_dir, t, batch_id - 1, _SCHEMAS[t]) for t in SNAPSHOTS}
    # the micro-batch is read by every merge below: keep it (bounded by the trigger)
    seq = F.struct(F.lit(batch_id).cast("bigint").alias("batch_id"), *ARRIVAL)
    ev = with_amount(events).withColumn("seq", seq).drop(*ARRIVAL).persist()
    gap = F.expr(f"INTERVAL {ACTIVE_GAP_SECONDS} SECONDS")

    pending: list[tuple[DataFrame, str]] = []

    def write(df: DataFrame, table: str) -> None:
        pending.append((df, table))

    # A2-A4: counters per type string
    batch_counts = ev.groupBy(type_key().alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
    write(prev["counts"].unionByName(batch_counts).groupBy("event_type").agg(F.sum("n").alias("n")),
          "counts")

    # A5: purchase counts per product name
    paid = purchases(ev)
    batch_products = paid.groupBy(product_key().alias("product_name")).agg(F.count(F.lit(1)).alias("n"))
    write(prev["products"].unionByName(batch_products).groupBy("product_name")
          .agg(F.sum("n").alias("n")), "products")

    # Sessions and members; (session, user) rows of the batch are bounded
    # by it and read by several plans below, so kept for the batch's duration
    per_user = session_users(ev).persist()
    sessions, members = _sessions_after(per_user, prev)
    sessions, members = sessions.persist(), members.persist()
    counted = members.groupBy("session").agg(F.count(F.lit(1)).alias("active_users"))
    closed = sessions.where(~F.col("open")).join(counted, "session")
    write(closed.select(F.col("start").alias("session_start"), (F.col("last") + gap).alias("session_end"),
                        "active_users", "events"), "sessions")
    newest = sessions.where("open").select("session")
    write(members.join(F.broadcast(newest), "session").select("user_id"), "users")     # one session number

    # A1, A3 and the open session's bounds: one row
    b_rev = paid.agg(F.coalesce(F.sum(to_money_acc(F.col("amount"))), F.lit(0).cast(MONEY_ACC))).scalar()
    b_events = ev.agg(F.count(F.lit(1))).scalar()
    c = prev["totals"].agg(F.struct(F.max("revenue_acc").alias("rev"), F.max("events").alias("events"))).scalar()
    o = sessions.where("open").agg(F.struct(
        F.max("start").alias("start"), F.max("last").alias("last"), F.max("events").alias("events"))).scalar()
    totals = spark.range(1).select(
        (F.coalesce(c["rev"], F.lit(0).cast(MONEY_ACC)) + b_rev).cast(MONEY_ACC).alias("revenue_acc"),
        (F.coalesce(c["events"], F.lit(0)) + b_events).cast("bigint").alias("events"),
        o["start"].alias("session_start"), o["last"].alias("last_ts"), o["events"].cast("bigint").alias("session_events"),
    )

    # L2: newest purchases (<= 20 rows), by event time, then arrival
    batch_hist = paid.select("ts", "seq", clock_label(F.col("ts")).alias("name"), to_money_acc(F.col("amount")).alias("acc"))
    write(prev["history"].unionByName(batch_hist).orderBy(F.desc("ts"), F.desc("seq")).limit(REVENUE_HISTORY_LIMIT),
          "history")

    # L3: newest feed rows (<= 15), in the same order
    feed = feed_projection(newest_feed_events(ev)).select(
        "ts", "seq", "id", "type", "title", "subtitle", F.lit(FEED_TIME_LABEL).alias("time"))
    write(prev["feed"].unionByName(feed).orderBy(F.desc("ts"), F.desc("seq")).limit(RECENT_EVENTS_LIMIT), "feed")

    # The snapshot tables are independent of each other: write them as
    # concurrent jobs; the one-row totals table goes last and marks the
    # version complete.
    def save(item: tuple[DataFrame, str]) -> None:
        df, table = item
        df.write.mode("overwrite").parquet(_path(state_dir, table, batch_id))

    with ThreadPoolExecutor(max_workers=len(pending)) as pool:
        list(pool.map(save, pending))
    save((totals, "totals"))
    _drop_old_versions(spark, state_dir, batch_id)
    for kept in (sessions, members, per_user, ev):
        kept.unpersist()


def first_deliveries(events: DataFrame, batch_id: int, state_dir: str, horizon: int | None = None) -> DataFrame:
    """T5 opt-in: the batch's events whose ``event_id`` is new; events without an id all pass.

    The ids first seen are written next to the state, per batch, so a replayed
    batch sees the same earlier ids.  ``horizon`` bounds how many earlier
    batches are looked at; None looks at all of them.
    """
    spark = events.sparkSession
    rank = F.row_number().over(Window.partitionBy("event_id", F.when(F.col("event_id").isNull(), F.struct("arrived_from", "arrived_at")))
                               .orderBy(*ARRIVAL))
    once = events.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    since = 0 if horizon is None else max(0, batch_id - horizon)
    if batch_id > since:
        seen = (spark.read.schema(_SCHEMAS["ids"] + ", v bigint").parquet(os.path.join(state_dir, "ids"))
                .where((F.col("v") >= since) & (F.col("v") < batch_id)).select("event_id"))
        once = once.join(seen, "event_id", "left_anti")
    once = once.persist()
    once.where("event_id IS NOT NULL").select("event_id").write.mode("overwrite").parquet(_path(state_dir, "ids", batch_id))
    return once


def process_json_batch(raw: DataFrame, batch_id: int, state_dir: str, dedup: bool = False,
                       dedup_horizon: int | None = None) -> None:
    """foreachBatch body: decode once, dead-letter the non-JSON, merge the rest."""
    decoded = decode(with_arrival(raw)).persist()
    rejects_from_decoded(decoded).write.mode("overwrite").parquet(_path(state_dir, "rejects", batch_id))
    events = lenient_from_decoded(decoded, "arrived", ARRIVAL)
    if dedup:
        events = first_deliveries(events, batch_id, state_dir, dedup_horizon)
    merge_batch(events, batch_id, state_dir)
    events.unpersist()
    decoded.unpersist()


def dedupe_stream(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """T5 for event-time pipelines: drop repeated ``event_id`` deliveries within the watermark.

    State holds the ids seen within the watermark delay, then expires them.
    Spark drops rows later than the watermark; the processor's own ``dedup``
    (``first_deliveries``) loses none.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return (timed.dropDuplicatesWithinWatermark(["event_id"])
            .withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def start_processor(raw_stream: DataFrame, state_dir: str, checkpoint_dir: str,
                    available_now: bool = False, processing_time: str | None = None,
                    dedup: bool = False, dedup_horizon: int | None = None):
    """Run the processor over a stream of JSON text rows (``value``).

    ``dedup=True`` counts every event id once (see ``first_deliveries``); the
    dead letter is written in either mode.
    """
    def body(df: DataFrame, batch_id: int) -> None:
        process_json_batch(df, batch_id, state_dir, dedup, dedup_horizon)

    writer = raw_stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint_dir)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def start_reject_sink(raw_stream: DataFrame, path: str, checkpoint_dir: str, available_now: bool = False):
    """T7 dead letter as its own append stream: messages that are not JSON objects."""
    writer = (lenient_rejects(raw_stream).writeStream.format("parquet")
              .option("path", path).option("checkpointLocation", checkpoint_dir))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


# ---------------------------------------------------------------------------
# Reading the state (the analytics side)
# ---------------------------------------------------------------------------
def latest_version(spark: SparkSession, state_dir: str) -> int:
    """Newest complete snapshot version (the one-row totals table is written
    last).  Read through partition discovery, so it works on any shared
    file system."""
    versions = spark.read.parquet(os.path.join(state_dir, "totals")).select(F.max("v"))
    return int(versions.first()[0])


def snapshot(spark: SparkSession, state_dir: str, version: int | None = None) -> dict[str, DataFrame]:
    v = latest_version(spark, state_dir) if version is None else version
    return {t: spark.read.schema(_SCHEMAS[t]).parquet(_path(state_dir, t, v)) for t in TABLES}


def snapshot_dashboard(spark: SparkSession, state_dir: str, version: int | None = None) -> DataFrame:
    """C1 served from a state snapshot (the same shape as the batch dashboard)."""
    st = snapshot(spark, state_dir, version)
    counts = st["counts"]

    def count_of(t: str):
        return F.coalesce(counts.where(F.col("event_type") == t).agg(F.sum("n")).scalar(), F.lit(0))

    totals = st["totals"]
    top = (st["products"].orderBy(F.desc("n"), F.desc("product_name")).limit(TOP_PRODUCTS_LIMIT))
    top_arr = top.agg(F.transform(
        F.sort_array(F.collect_list(F.struct(F.col("n").alias("_k0"), F.col("product_name").alias("_k1"))),
                     asc=False),
        lambda x: F.struct(x["_k1"].alias("product_name"), x["_k0"].alias("purchase_count")))).scalar()
    feed_arr = st["feed"].agg(F.transform(
        F.sort_array(F.collect_list(F.struct("ts", "seq", "id", "type", "title", "subtitle", "time")), asc=False),
        lambda x: F.struct(*[x[f].alias(f) for f in ("id", "type", "title", "subtitle", "time")]))).scalar()
    # running total at a row = grand total less the newer rows, all of which are listed
    total = totals.select(F.max("revenue_acc")).scalar()
    newer = Window.orderBy(F.desc("ts"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    hist = st["history"].select("ts", "seq", "name", (
        total - F.coalesce(F.sum("acc").over(newer), F.lit(0).cast(MONEY_ACC))).cast(MONEY_ACC).alias("running"))
    hist_arr = hist.agg(F.transform(
        F.sort_array(F.collect_list(F.struct("ts", "seq", "name", "running"))),
        lambda x: F.struct(x["name"].alias("name"), money_total(x["running"]).alias("revenue")))).scalar()
    users = st["users"].agg(F.count(F.lit(1))).scalar()
    return totals.select(
        F.struct(money_total(F.col("revenue_acc")).alias("total_revenue"),
                 F.lit(CURRENCY).alias("currency")).alias("revenue"),
        F.struct(top_arr.alias("products")).alias("top_products"),
        F.struct(*[count_of(t).cast("bigint").alias(t) for t in EVENT_TYPES],
                 F.col("events").alias("total")).alias("event_counts"),
        F.struct(users.alias("active_users"), F.lit(ACTIVE_WINDOW_LABEL).alias("window")).alias("active_users"),
        feed_arr.alias("recent_events"),
        hist_arr.alias("revenue_history"),
    )
