"""Windowed revenue that takes late rows as corrections.

Spark's own windowed streams drop a row that comes after its window closed.  Here a closed window is corrected
instead.  Each micro-batch reduces its purchases to one delta per window and sorts the deltas by the *closing
line* (the newest event time seen before the batch, less a delay; it never moves back):

* windows the line has not reached: merged into ``open/``, one row per open window;
* windows it has passed: looked up among the days they fall on, and written to ``changes/`` as a pair, the
  ``retract`` of the value published before and the ``upsert`` of the corrected one.

Windows that the batch's own events bring under the line are published as an ``insert``.  ``changes/`` is an
append-only log, partitioned by batch and day; a reader of the log gets every window's value by adding up
inserts and upserts and taking off retracts, whatever it has seen before.  ``marks/`` holds the line and is
written last: it makes a version count.  A batch id that runs again writes the same version over.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.money import MONEY_ACC, money_total, to_money_acc
from ..operators.events import purchases
from .processor import _check_marks, _path, drop_version

DELAY = "1 minute"
VALUES = f"window_start timestamp_ntz, window_end timestamp_ntz, acc {MONEY_ACC}, purchases bigint"
CHANGES = f"{VALUES}, op string, v bigint, day date"
MARKS = "line timestamp_ntz, newest timestamp_ntz"
INSERT, RETRACT, UPSERT = "insert", "retract", "upsert"


def _sign() -> F.Column:
    return F.when(F.col("op") == RETRACT, -1).otherwise(1)


def window_deltas(events: DataFrame, duration: str) -> DataFrame:
    """What the events add to each window: exact revenue and purchases."""
    return (purchases(events).groupBy(F.window("ts", duration).alias("w"))
            .agg(F.sum(to_money_acc(F.col("amount"))).cast(MONEY_ACC).alias("acc"), F.count(F.lit(1)).alias("purchases"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "acc", "purchases"))


def _folded(changes: DataFrame) -> DataFrame:
    """The value of each window after a run of changes."""
    return (changes.groupBy("window_start", "window_end")
            .agg(F.sum(F.col("acc") * _sign()).cast(MONEY_ACC).alias("acc"),
                 F.sum(F.col("purchases") * _sign()).alias("purchases")))


def _merged(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (out.groupBy("window_start", "window_end")
            .agg(F.sum("acc").cast(MONEY_ACC).alias("acc"), F.sum("purchases").alias("purchases")))


def changes(spark: SparkSession, state_dir: str, before: int | None = None) -> DataFrame:
    """The change log, of the versions that count."""
    log = spark.read.schema(CHANGES).parquet(os.path.join(state_dir, "changes"))
    return log if before is None else log.where(F.col("v") < before)


def fold_batch(events: DataFrame, batch_id: int, state_dir: str, duration: str = "1 minute", delay: str = DELAY) -> None:
    """foreachBatch body: one micro-batch of canonical events (TIMESTAMP_NTZ) into the next version."""
    spark = events.sparkSession
    _check_marks(spark, state_dir, batch_id, "marks")
    if batch_id > 0:
        mark = spark.read.schema(MARKS).parquet(_path(state_dir, "marks", batch_id - 1))
        still_open = spark.read.schema(VALUES).parquet(_path(state_dir, "open", batch_id - 1))
    else:
        mark, still_open = spark.createDataFrame([(None, None)], MARKS), spark.createDataFrame([], VALUES)
    old = mark.select(F.struct("line", "newest")).scalar()
    events = events.persist()                              # bounded by the trigger
    newest = events.agg(F.max("ts")).scalar()
    newest = F.greatest(newest, old["newest"])
    next_mark = spark.range(1).select(
        F.greatest(newest - F.expr(f"INTERVAL {delay}"), old["line"]).alias("line"), newest.alias("newest")).persist()
    line = next_mark.select("line").scalar()

    deltas = window_deltas(events, duration).persist()
    is_late = F.coalesce(F.col("window_end") <= old["line"], F.lit(False))
    late = deltas.where(is_late)
    windows = _merged(still_open, deltas.where(~is_late)).persist()
    closes = F.coalesce(F.col("window_end") <= line, F.lit(False))

    log = windows.where(closes).withColumn("op", F.lit(INSERT))
    if batch_id > 0:                                       # nothing is published before the first batch
        # only the days that late rows fall on are read, and of those only the late windows
        days = late.select(F.to_date("window_start").alias("day")).distinct()
        published = changes(spark, state_dir, batch_id).join(F.broadcast(days), "day", "left_semi")
        published = _folded(published.join(late.select("window_start"), "window_start", "left_semi"))
        old_values = published.where("purchases > 0").persist()
        log = (log.unionByName(old_values.withColumn("op", F.lit(RETRACT)))
               .unionByName(_merged(old_values, late).withColumn("op", F.lit(UPSERT))))
    log = log.withColumn("day", F.to_date("window_start"))
    log.write.mode("overwrite").partitionBy("day").parquet(_path(state_dir, "changes", batch_id))
    windows.where(~closes).write.mode("overwrite").parquet(_path(state_dir, "open", batch_id))
    next_mark.write.mode("overwrite").parquet(_path(state_dir, "marks", batch_id))
    drop_version(spark, state_dir, "open", batch_id - 2)
    for kept in (events, deltas, windows, next_mark):
        kept.unpersist()


def start_corrections(events: DataFrame, state_dir: str, checkpoint: str, duration: str = "1 minute",
                      delay: str = DELAY, available_now: bool = True):
    """Run the corrections over a stream of canonical events."""
    def body(batch: DataFrame, batch_id: int) -> None:
        fold_batch(batch, batch_id, state_dir, duration, delay)

    writer = events.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def window_values(spark: SparkSession, state_dir: str, with_open: bool = True) -> DataFrame:
    """Every window's present value: the log folded, and the open windows as far as they have come."""
    marks = spark.read.schema(MARKS + ", v bigint").parquet(os.path.join(state_dir, "marks"))
    last = int(marks.agg(F.max("v")).first()[0])
    values = _folded(changes(spark, state_dir, last + 1))
    if with_open:
        values = values.unionByName(spark.read.schema(VALUES).parquet(_path(state_dir, "open", last)))
    return values.select("window_start", "window_end", money_total(F.col("acc")).alias("revenue"), "purchases")
