"""Active users: the global idle-gap session (as the reference computes it)
and a true trailing window.

The reference adds every event's user to one set and pushes the set's expiry
300 s into the future, so the set is a *global session* with a 300 s gap:
it empties only after 300 s without any event, from any user.

Batch sessionization without sorting the events: any two events in the same
300 s bucket are less than 300 s apart, so a bucket never splits.  Buckets
(at most 288 a day, however many events) carry (first, last) timestamps;
sessions break where ``first - previous last >= 300 s``.  Users are then
attributed to sessions through a join on the bucket key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import ACTIVE_GAP_SECONDS, ACTIVE_WINDOW_LABEL, UNKNOWN
from .joins import join_dimension
from .timecols import epoch_micros, from_micros

def _user_key():
    return F.coalesce(F.col("user_id"), F.lit(UNKNOWN))


def bucket_users(events: DataFrame, gap_seconds: int = ACTIVE_GAP_SECONDS) -> DataFrame:
    """One scan of the events: ``(bucket, user_id, n, lo, hi)`` per gap-sized
    bucket and user, partially aggregated map-side."""
    gap_us = gap_seconds * 1_000_000
    return (events.select(F.floor(epoch_micros(events) / gap_us).cast("bigint").alias("bucket"),
                          _user_key().alias("user_id"), epoch_micros(events).alias("us"))
            .where("bucket IS NOT NULL")             # said here, both uses below plan the same shuffle
            .groupBy("bucket", "user_id")
            .agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi")))


def _session_starts(buckets: DataFrame, gap_seconds: int) -> DataFrame:
    """``(bucket, lo, hi, start_us)``: ``start_us`` = ``lo`` where a session
    begins (the previous bucket ended ``gap`` or more earlier), else null.

    The bucket table has at most one row per ``gap`` of elapsed time (288 a
    day, 105,120 a year), whatever the event volume, so one ordered window
    over it is bounded work; the event rows themselves never meet a
    partition-free window.
    """
    gap_us = gap_seconds * 1_000_000
    prev_hi = F.lag("hi").over(Window.orderBy("bucket"))
    return buckets.select(
        "bucket", "lo", "hi",
        F.when(prev_hi.isNull() | (F.col("lo") - prev_hi >= gap_us), F.col("lo")).alias("start_us"))


def session_map(per_bucket_user: DataFrame, gap_seconds: int = ACTIVE_GAP_SECONDS) -> DataFrame:
    """``bucket -> session_us``: the session (keyed by its first event time,
    in epoch micros) every non-empty gap-sized bucket belongs to."""
    # n is kept, so that map and attribution read the very same shuffle
    buckets = (per_bucket_user.groupBy("bucket")
               .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
               .where("n > 0").drop("n"))
    starts = _session_starts(buckets, gap_seconds)
    in_time = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return starts.select("bucket", F.last("start_us", ignorenulls=True).over(in_time).alias("session_us"))


def session_users(events: DataFrame, gap_seconds: int = ACTIVE_GAP_SECONDS) -> DataFrame:
    """``(session_us, user_id, n, first_ts, last_ts)``: every user of every
    global session.  The map and the attribution derive from one (bucket,
    user) aggregate and use all its columns, so its shuffle is planned once
    (ReusedExchange) and the event table scanned once."""
    per_bucket_user = bucket_users(events, gap_seconds)
    smap = session_map(per_bucket_user, gap_seconds)
    attributed = join_dimension(per_bucket_user, smap, "bucket", how="inner")
    return (attributed.groupBy("session_us", "user_id")
            .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .select("session_us", "user_id", "n", from_micros(events, F.col("lo")).alias("first_ts"),
                    from_micros(events, F.col("hi")).alias("last_ts")))


def sessions_of(per_user: DataFrame, gap_seconds: int = ACTIVE_GAP_SECONDS) -> DataFrame:
    """Session rows from ``session_users`` rows (Spark's session-window
    convention: ``session_end`` = last event + gap)."""
    return (per_user.groupBy("session_us")
            .agg(F.min("first_ts").alias("session_start"),
                 F.max("last_ts").alias("last_ts"),
                 F.count(F.lit(1)).alias("active_users"),
                 F.sum("n").alias("events"))
            .select("session_start",
                    (F.col("last_ts") + F.expr(f"INTERVAL {gap_seconds} SECONDS")).alias("session_end"),
                    "active_users", "events"))


def global_sessions(events: DataFrame, gap_seconds: int = ACTIVE_GAP_SECONDS) -> DataFrame:
    """A6 history: every global session with its distinct-user count."""
    return sessions_of(session_users(events, gap_seconds), gap_seconds)


def session_bounds(buckets: DataFrame, gap_seconds: int = ACTIVE_GAP_SECONDS, *carried) -> DataFrame:
    """One row: ``start_us`` and ``last_us`` of the newest global session, from
    rows ``(bucket, lo, hi, ...)``, next to the ``carried`` aggregates."""
    starts = buckets.withColumn("_prev", F.lag("hi").over(Window.orderBy("bucket")))
    begins = F.col("_prev").isNull() | (F.col("lo") - F.col("_prev") >= gap_seconds * 1_000_000)
    return starts.agg(F.max(F.when(begins, F.col("lo"))).alias("start_us"), F.max("hi").alias("last_us"), *carried)


def users_since(events: DataFrame, start_us) -> DataFrame:
    """One row: distinct users at or after ``start_us``; the filter is on the
    plain time column, which a scan can prune row groups by."""
    return (events.where(F.col("ts") >= from_micros(events, start_us))
            .agg(F.count_distinct(_user_key()).alias("users")))


def open_users(users, bounds, as_of=None, gap_seconds: int = ACTIVE_GAP_SECONDS):
    """The count of ``users`` if the newest session is still open at ``as_of``, else 0."""
    as_of_us = bounds["last_us"] if as_of is None else F.unix_micros(F.lit(as_of).cast("timestamp"))
    open_now = bounds["last_us"].isNotNull() & (as_of_us < bounds["last_us"] + gap_seconds * 1_000_000)
    return F.when(open_now, users).otherwise(F.lit(0)).cast("bigint")


def active_users_now(events: DataFrame, as_of=None, gap_seconds: int = ACTIVE_GAP_SECONDS) -> DataFrame:
    """A6 as read by the dashboard: users of the session open at ``as_of``.

    The open session is the last one, and it holds every event from its
    first event on; so its start comes from the bucket table and its users
    are a distinct count over the events at or after that start - no
    per-session attribution needed.  ``as_of`` defaults to the newest event
    time, never the wall clock; the session is open while
    ``as_of < last event + gap``.  One row even with no events (0 users).
    """
    us = epoch_micros(events)
    buckets = (events.select(F.floor(us / (gap_seconds * 1_000_000)).cast("bigint").alias("bucket"), us.alias("us"))
               .groupBy("bucket").agg(F.min("us").alias("lo"), F.max("us").alias("hi")))
    bounds = session_bounds(buckets, gap_seconds).select(F.struct("start_us", "last_us")).scalar()
    return users_since(events, bounds["start_us"]).select(
        open_users(F.col("users"), bounds, as_of, gap_seconds).alias("active_users"),
        F.lit(ACTIVE_WINDOW_LABEL).alias("window"),
    )


def active_users_sliding(events: DataFrame, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Exact distinct users per sliding window.

    Catalyst expands each event into its windows map-side and de-duplicates
    (window, user) pairs in a partial aggregate before the shuffle.
    """
    return (events.groupBy(F.window("ts", length, slide).alias("w"))
            .agg(F.count_distinct(_user_key()).alias("active_users"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "active_users"))
