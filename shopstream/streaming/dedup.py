"""Every event id once, exactly, for as long as the stream runs (T5).

The index of seen ids is Spark's keyed state in RocksDB: ids are hashed to state partitions, each a compacted
sorted store on disk.  A micro-batch looks up its own ids and writes its new ones; what it reads and uploads
follows the batch, not the ids seen so far.  No id is ever forgotten, unless a watermark is asked for.
Events without an id are different events and all pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def unique_events(events: DataFrame, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """The stream without redeliveries of an ``event_id``.  Needs RocksDB state (``replay.state_conf``).

    With ``watermark``, an id is forgotten that long after its event (``time`` must be a TIMESTAMP), which
    bounds the state; Spark then drops rows that come later than that.
    """
    with_id, without = events.where("event_id IS NOT NULL"), events.where("event_id IS NULL")
    if watermark is None:
        return with_id.dropDuplicates(["event_id"]).unionByName(without)
    return (with_id.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["event_id"])
            .unionByName(without.withWatermark(time, watermark)))


def unique_messages(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """The same for raw JSON messages, ahead of the processor: messages without a readable id all pass."""
    if "event_id" in raw.columns:
        raise ValueError("raw messages carry their id inside the JSON text")
    told = raw.withColumn("event_id", F.try_variant_get(F.try_parse_json(F.col(value_col)), "$.event_id", "string"))
    return unique_events(told).drop("event_id")
