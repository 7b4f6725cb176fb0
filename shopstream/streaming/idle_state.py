"""Global idle-timeout sessions in Spark's keyed state with event-time timers.

The users are dealt over shards, so no task holds a session's users.  A shard keeps one open *piece* in state:
the first and last event time of a run of its events with gaps under the limit, and an event count per user.
An event-time timer, moved by every event as the reference moves its set's expiry, ends the piece when the
watermark is a gap beyond its last event: its users are emitted and the state is cleared.

A shard sees a part of the events, so its pieces may be shorter than the global sessions.  That is harmless:
any two pieces less than a gap apart belong to one session, so a second stage joins the pieces of all shards
into sessions and counts the distinct users of each (``sessions_of_pieces``).  The open session needs no end
of input: its pieces are read out of the state store (``open_pieces``).

A micro-batch appends its users to the state packed in arrays, a few calls however many users it brings, and reads
nothing back.  When the state holds ``SLACK`` more than twice what it held after its last merge, its users are
merged: it stays within about twice the piece's users, and a merge's work is shared by the appends since the last.

A user's events are dealt by user and minute, so that one very busy user is spread as well.  Events later than
the watermark are dropped by Spark; the snapshot processor (``processor``) is the path that loses none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.active_users import session_map, sessions_of
from ..operators.timecols import epoch_micros, from_micros
from ..schema import ACTIVE_GAP_SECONDS, UNKNOWN

SHARDS = 32
_COLUMNS = ["shard", "user_id", "lo", "hi", "n"]
PACK = 10_000                # users of one packed entry
SLACK = 20_000               # users the state may hold unmerged whatever the piece's size
PIECES = "shard int, user_id string, lo bigint, hi bigint, n bigint"


def _processor(gap_seconds: int) -> StatefulProcessor:
    gap = gap_seconds * 1_000_000

    class OpenPiece(StatefulProcessor):
        """State of a shard: ``bounds`` (lo, hi in epoch microseconds; users held, and held after the last merge)
        and ``members`` (users and their events, packed; a user may stand in several entries)."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.bounds = handle.getValueState("bounds", "lo bigint, hi bigint, held bigint, merged bigint")
            self.members = handle.getListState("members", "user_ids array<string>, ns array<bigint>")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows)).sort_values("us")           # a shard's part of one micro-batch
            batch["run"] = (batch["us"].diff() >= gap).cumsum()       # events with gaps under the limit
            runs = batch.groupby("run")["us"].agg(lo="min", hi="max")
            counts = batch.groupby(["run", "user_id"]).size().rename("n").reset_index().join(runs, on="run")
            lo, hi, held, merged = self.bounds.get() if self.bounds.exists() else (None, None, 0, 0)
            before = hi
            if lo is None:
                early, late = counts["run"] < 0, counts["run"] >= 0
            else:                                                     # runs lie a gap apart: they extend the open piece, not each other
                early, late = counts["hi"] <= lo - gap, counts["lo"] >= hi + gap
            joined = counts[~early & ~late]
            if len(joined):
                lo, hi = min(lo, int(joined["lo"].min())), max(hi, int(joined["hi"].max()))
            joined = joined.groupby("user_id")["n"].sum()
            over = early                                              # out of order: pieces of their own
            if late.any():
                if lo is not None:                                    # the open piece is over
                    yield self._close(key, lo, hi, joined)
                over = early | (late & (counts["run"] != counts["run"].iloc[-1]))   # over within the batch: never stored
                last = counts[counts["run"] == counts["run"].iloc[-1]]
                lo, hi, held, merged = int(last["lo"].iloc[0]), int(last["hi"].iloc[0]), 0, 0
                joined = last.set_index("user_id")["n"]
            if over.any():
                yield counts[over].assign(shard=key[0])[_COLUMNS]
            held += len(joined)
            if held > 2 * merged + SLACK:
                joined = self._members(joined)
                self.members.clear()
                held = merged = len(joined)
            for at in range(0, len(joined), PACK):
                pack = joined.iloc[at:at + PACK]
                self.members.appendValue((pack.index.tolist(), pack.tolist()))
            if before is not None and before != hi:
                self.handle.deleteTimer(self._expiry(before))
            if before != hi:
                self.handle.registerTimer(self._expiry(hi))
            self.bounds.update((lo, hi, held, merged))

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            if self.bounds.exists():
                lo, hi = self.bounds.get()[:2]
                if self._expiry(hi) <= expiredTimerInfo.getExpiryTimeInMs():
                    yield self._close(key, lo, hi)
                    self.bounds.clear()

        def close(self) -> None:
            pass

        def _expiry(self, hi: int) -> int:
            return -(-(hi + gap) // 1000)

        def _close(self, key: Any, lo: int, hi: int, more: pd.Series | None = None) -> pd.DataFrame:
            users = self._members(more)
            self.members.clear()
            return pd.DataFrame({"shard": key[0], "user_id": users.index, "lo": lo, "hi": hi, "n": users.to_numpy()})[_COLUMNS]

        def _members(self, more: pd.Series | None = None) -> pd.Series:
            """Events by user: those held, where a user may stand several times, and ``more``."""
            packs = [pd.Series(ns, index=users, dtype="int64") for users, ns in self.members.get()]
            return pd.concat(packs + ([] if more is None else [more])).groupby(level=0).sum()

    return OpenPiece()


def session_pieces(events: DataFrame, gap_seconds: int = ACTIVE_GAP_SECONDS, watermark: str = "1 minute",
                   shards: int = SHARDS) -> DataFrame:
    """The stream of closed pieces: (shard, user_id, lo, hi, n).  Needs RocksDB state (``replay.state_conf``)."""
    user = F.coalesce(F.col("user_id"), F.lit(UNKNOWN))
    us = epoch_micros(events)
    slim = (events.where("ts IS NOT NULL")
            .select(F.col("ts").cast("timestamp").alias("ts"), us.alias("us"), user.alias("user_id"))
            .withWatermark("ts", watermark)
            .withColumn("shard", F.pmod(F.xxhash64("user_id", F.floor(F.col("us") / 60_000_000)), F.lit(shards)).cast("int")))
    return slim.groupBy("shard").transformWithStateInPandas(
        _processor(gap_seconds), outputStructType=PIECES, outputMode="Append", timeMode="EventTime")


def start_pieces(pieces: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Write closed pieces as Parquet."""
    writer = (pieces.writeStream.outputMode("append").format("parquet")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def open_pieces(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The pieces still open, out of the state store of the last committed batch; a user may come in several rows."""
    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    bounds = state("bounds").select(F.col("key.shard").alias("shard"), "value.lo", "value.hi")
    packs = state("members").select(F.col("key.shard").alias("shard"), "list_element.user_ids", "list_element.ns")
    # a row per shard; the users are opened after the join, which then moves packs
    return packs.join(F.broadcast(bounds), "shard").select("shard", "lo", "hi", F.inline(F.arrays_zip("user_ids", "ns"))).select(
        "shard", F.col("user_ids").alias("user_id"), "lo", "hi", F.col("ns").alias("n"))


def sessions_of_pieces(pieces: DataFrame, events: DataFrame, gap_seconds: int = ACTIVE_GAP_SECONDS) -> DataFrame:
    """Global sessions (session_start, session_end, active_users, events) of all shards' pieces.

    A piece covers its time buckets without a gap, so the ordered step runs over one row per bucket (288 a
    day), and users are counted by (session, user).  ``events`` only gives the type of the time columns.
    """
    gap = gap_seconds * 1_000_000
    spans = pieces.groupBy("shard", "lo", "hi").agg(F.sum("n").alias("n"))
    first = F.floor(F.col("lo") / gap).cast("bigint")
    covered = spans.withColumn("bucket", F.explode(F.sequence(first, F.floor(F.col("hi") / gap).cast("bigint"))))
    buckets = covered.select("bucket", F.greatest("lo", F.col("bucket") * gap).alias("lo"),
                             F.least("hi", (F.col("bucket") + 1) * gap - 1).alias("hi"), "n")
    which = session_map(buckets, gap_seconds).withColumnRenamed("bucket", "_bucket")
    per_user = (pieces.join(which, first == F.col("_bucket")).groupBy("session_us", "user_id")
                .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                .select("session_us", "user_id", "n", from_micros(events, F.col("lo")).alias("first_ts"),
                        from_micros(events, F.col("hi")).alias("last_ts")))
    return sessions_of(per_user, gap_seconds)
