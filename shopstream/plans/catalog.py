"""Query registry: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables through an adapter, so its work grows
with the tables.  ``__spark_entry__`` only re-exports this registry.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import active_users, counts, feed, products, revenue, trend
from ..operators.enrich import enrich_events
from ..operators.events import dedupe_events, purchases, with_amount
from . import dashboard, streams, timeline
from ..sources import archive, json_events as wire
from ..sources.placement import partition_of
from ..sources.profile import field_profile
from ..sources.adapters import sales, shop_events
from ..sources.tables import read_table
from ..schema import PURCHASE_COMPLETED
from ..session import ensure_checkpoint_dir
from ..streaming import processor
from ..streaming.replay import run_folder

Query = Callable[[SparkSession, str], DataFrame]

ARCHIVE_DAYS = 7             # that archive_user_history goes back, the newest included
KAFKA_PARTITIONS = 12        # of the topic that kafka_partitions places events on
STREAM_FILES = 8             # the stream queries replay the events from so many files


def _on_events(metric: Callable[[DataFrame], DataFrame], names: bool = True) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metric(shop_events(spark, sf_dir, with_names=names))
    run.__doc__ = metric.__doc__
    return run


def _on_purchases(metric: Callable[[DataFrame], DataFrame], names: bool = False) -> Query:
    """Purchases only: the type filter reaches the parquet scan, and the
    product-name join runs only for metrics that read names."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ev = shop_events(spark, sf_dir, only_types=[PURCHASE_COMPLETED], with_names=names)
        return metric(purchases(ev))
    run.__doc__ = metric.__doc__
    return run


def _on_sales(metric: Callable[[DataFrame], DataFrame], with_date: bool, with_name: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metric(sales(spark, sf_dir, with_date=with_date, with_name=with_name))
    run.__doc__ = metric.__doc__
    return run


def _purchase_amount(events: DataFrame) -> DataFrame:
    """P1 + F1: every purchase with its amount (price x quantity)."""
    return purchases(events).select("event_id", "ts", "product_name", "price", "quantity", "amount")


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product attributes (and the name) from one join with ``part``."""
    return enrich_events(shop_events(spark, sf_dir, with_names=False), read_table(spark, sf_dir, "part"),
                         fill_names=True)


def _kafka_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Kafka record (key = user id, value = JSON) of every event."""
    return wire.to_wire(shop_events(spark, sf_dir))


def _archive_user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last week of the newest day's busiest users, looked up in the compacted archive."""
    path = os.path.join(run_folder(spark, "archive"), "events")
    archive.compact(shop_events(spark, sf_dir, with_names=False).select("seq", "event_id", "event_type", "user_id", "ts"), path)
    stored = archive.read_archive(spark, path)
    day = stored.agg(F.max("event_date")).first()[0]
    first = day and day - dt.timedelta(days=ARCHIVE_DAYS - 1)
    found = archive.user_history(stored, archive.busiest_users(stored, day) if day else [], first, day)
    return found.select("event_id", "event_type", "user_id", "ts")


def _kafka_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the topic partition of every event, by the producer's hash of its key (the user id)."""
    events = shop_events(spark, sf_dir, with_names=False)
    return events.select("event_id", partition_of(F.col("user_id"), KAFKA_PARTITIONS).alias("partition"))


def _wire_field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and kinds of the events' messages with a session id and a nested context, which the model doesn't know."""
    rows, seq = _kafka_rows(spark, sf_dir), F.get_json_object("value", "$.event_id").cast("bigint")
    more = F.concat(F.lit(',"session_id":"s'), (seq % 50).cast("string"), F.lit('","context":{"tags":["a",'), (seq % 3).cast("string"),
                    F.when(seq % 4 == 0, F.lit(',{"deep":[true]}')).otherwise(F.lit("")), F.lit('],"ref":null}}'))
    cut = F.when(seq % 100 == 7, F.lit("")).otherwise(more)                # some messages break off
    return field_profile(rows.select(F.concat(F.substr("value", F.lit(1), F.length("value") - 1), cut).alias("value")))


def _metadata_text(df: DataFrame) -> DataFrame:
    return df.withColumn("metadata", F.to_json("metadata"))


def _valid_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1-V4: every event through the ingest contract (JSON round trip)."""
    return _metadata_text(wire.valid_events(_kafka_rows(spark, sf_dir)))


def _rejected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: the driver's events as an unconverted client sends them (its own
    type names) - the ingest contract rejects them, with reasons."""
    return wire.rejected_events(wire.to_wire(shop_events(spark, sf_dir, map_types=False)))


def _lenient_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: the processor's lenient reading of every event, with its amount."""
    return _metadata_text(with_amount(wire.parse_lenient(_kafka_rows(spark, sf_dir))))


def _parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 (JSON half): Kafka records decoded into canonical events, key kept."""
    rows = _kafka_rows(spark, sf_dir)
    parsed = wire.parse_lenient(rows.withColumnRenamed("key", "kafka_key"))
    return parsed.select("event_id", "event_type", "user_id", "product_name", "price", "quantity", "ts")


def _awkward_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as JSON lines, some of them without fields or with odd ones (by ``seq``):
    every 7th without id, every 11th without time, every 13th with a text epoch, every 17th
    a quantity beyond 32 bits, every 19th a price beyond any accumulator, every 23rd a NaN price."""
    ev = shop_events(spark, sf_dir)
    seq = F.col("seq")

    def field(name: str, value):
        return F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))         # ids and types need no escapes

    price = (F.when(seq % 19 == 0, F.lit("1e40")).when(seq % 23 == 0, F.lit('"nan"'))
             .otherwise(F.coalesce(F.col("price").cast("string"), F.lit("null"))))
    quantity = F.when(seq % 17 == 0, F.lit("3000000000")).otherwise(F.col("quantity").cast("string"))
    time = (F.when(seq % 11 == 0, F.lit(None).cast("string"))
            .when(seq % 13 == 0, F.lit('"timestamp":"1704110400"'))
            .otherwise(F.concat(F.lit('"timestamp":"'), wire.iso_text(F.col("ts")), F.lit('"'))))
    parts = [F.when(seq % 7 != 0, field("event_id", F.col("event_id"))), field("event_type", F.col("event_type")),
             F.when(F.col("user_id").isNotNull(), field("user_id", F.col("user_id"))),
             F.concat(F.lit('"price":'), price), F.concat(F.lit('"quantity":'), quantity), time]
    return ev.select("seq", F.col("ts").alias("sent"), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


def _lenient_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 on events with absent or odd fields; a missing time becomes the arrival time (here: when it was sent)."""
    raw = _awkward_wire(spark, sf_dir)
    events = wire.lenient_from_decoded(wire.decode(raw), "sent", ("seq",))
    return events.select("seq", "event_id", "event_type", "user_id", "quantity", "ts")


def _dedup_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 where every 7th event has no id and every 5th is delivered twice: id-less events all count."""
    ev = shop_events(spark, sf_dir, with_names=False).withColumn(
        "event_id", F.when(F.col("seq") % 7 != 0, F.col("event_id")))
    twice = ev.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.when(F.col("seq") % 5 == 0, 1).otherwise(0))))
    return counts.event_counts_dedup(twice.drop("_copy"))


def _bad_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A3, T6 with amounts that can't be added up: they count as events and add nothing."""
    events = wire.lenient_from_decoded(wire.decode(_awkward_wire(spark, sf_dir)), "sent")
    return counts.kpi_aggregates(events).select("total", "purchase_completed", "total_revenue")


def _dashboard_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 as the documented payload: kpis, charts and live events in one row."""
    return dashboard.dashboard_payload(shop_events(spark, sf_dir, with_names=False), _part(spark, sf_dir))


def _dashboard_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 at the end of every hour: one row per hour, one job."""
    return timeline.dashboard_timeline(shop_events(spark, sf_dir, with_names=False), _part(spark, sf_dir))


def _odd_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as ingest requests, most of them faulty in a way that their ``seq`` chooses; some lack optional fields."""
    ev = shop_events(spark, sf_dir, with_names=False)
    kind = F.col("seq") % 10

    def text(name: str, value):
        return F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))

    parts = [
        text("event_id", F.col("event_id")),
        text("event_type", F.when(kind == 1, F.lit("page_closed")).otherwise(F.col("event_type"))),
        F.when(kind != 2, text("user_id", F.coalesce("user_id", F.lit("anonymous")))),
        F.when(kind == 3, F.lit('"product_id":17')).otherwise(text("product_id", F.lit("17"))),
        F.when(kind != 2, F.lit('"product_name":"thing"')),
        F.when(kind == 4, F.lit('"price":"cheap"')).otherwise(F.lit('"price":"2.5"')),
        F.when(kind == 5, F.lit('"quantity":1.5')).when(kind != 9, F.lit('"quantity":2')),
        F.when(kind == 6, F.lit('"timestamp":"yesterday"')).otherwise(
            F.concat(F.lit('"timestamp":"'), wire.iso_text(F.col("ts")), F.lit('Z"'))),
        F.when(kind == 7, F.lit('"metadata":[1]')).when(kind == 8, F.lit('"metadata":{"n":5}')),
        F.lit('"extra":true')]
    line = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.when(kind == 0, F.lit("")).otherwise(F.lit("}")))
    return ev.select(line.alias("value"))


def _ingest_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1-V5: how many requests are valid ('') or rejected, by their reasons."""
    return (wire.validate_strict(_odd_ingest(spark, sf_dir)).groupBy("reasons")
            .agg(F.count(F.lit(1)).alias("requests")))


def _ingest_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, V4: valid requests with optional fields filled and unknown ones dropped."""
    return _metadata_text(wire.valid_events(_odd_ingest(spark, sf_dir)))


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part")


def _paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases without names: type filter in the scan, no name join."""
    return purchases(shop_events(spark, sf_dir, only_types=[PURCHASE_COMPLETED], with_names=False))


def _product_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: counted per product id, named once per product."""
    return products.product_counts_by_id(_paid(spark, sf_dir), _part(spark, sf_dir))


def _top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 over the eagerly aggregated product counts."""
    return products.top_by_count(_product_counts(spark, sf_dir))


def _top_products_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.top_products_percent(None, top=_top_products(spark, sf_dir))


def _named_feed(metric: Callable[..., DataFrame]) -> Query:
    """Feed queries: newest rows picked on nameless events, then named."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metric(shop_events(spark, sf_dir, with_names=False), names=_part(spark, sf_dir))
    run.__doc__ = metric.__doc__
    return run


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")


def _sales_by_period(unit: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """D7 on the sales view: lines summed per order before the date join."""
        return revenue.revenue_by_period_via_orders(
            _lines(spark, sf_dir), read_table(spark, sf_dir, "orders"), unit)
    return run


def _sales_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 on the sales view: lines counted per part key before the name join."""
    counts = products.product_counts_by_id(_lines(spark, sf_dir), _part(spark, sf_dir), id_col="l_partkey")
    return products.top_by_count(counts)


def _sales_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6 on the sales view, monthly."""
    return trend.trend_from_periods(_sales_by_period("month")(spark, sf_dir))


def _stream_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 through the streaming processor (T1-T4, S1, S4): the events are
    written as JSON lines, consumed by the foreachBatch processor with
    ``availableNow``, and the dashboard is served from the final snapshot.
    Everything lives under a fresh folder in ``spark.checkpoint.dir``."""
    run = os.path.join(ensure_checkpoint_dir(spark), f"stream-dashboard-{uuid.uuid4().hex}")
    src = os.path.join(run, "source")
    # several files in arrival order, one or two per micro-batch: the state merge is exercised
    rows = shop_events(spark, sf_dir).repartitionByRange(STREAM_FILES, "seq").sortWithinPartitions("seq")
    wire.to_wire(rows).select("value").write.text(src)
    query = processor.start_processor(wire.stream_json_lines(spark, src, max_files_per_trigger=2),
                                      os.path.join(run, "state"), os.path.join(run, "checkpoint"), available_now=True)
    query.awaitTermination()
    return processor.snapshot_dashboard(spark, os.path.join(run, "state"))


def queries() -> dict[str, Query]:
    return {
        # single-scan aggregates
        "event_counts": _on_events(counts.event_counts, names=False),
        "events_by_type": _on_events(counts.events_by_type, names=False),
        "event_counts_dedup": _on_events(counts.event_counts_dedup, names=False),
        "revenue_total": _on_events(counts.revenue_total, names=False),
        "cart_abandonment": _on_events(counts.cart_abandonment, names=False),
        "failed_payment_rate": _on_events(counts.failed_payment_rate, names=False),
        "event_breakdown": _on_events(counts.event_breakdown, names=False),
        "purchase_amount": _on_purchases(_purchase_amount, names=True),
        # products
        "product_counts": _product_counts,
        "top_products": _top_products,
        "top_products_percent": _top_products_percent,
        # time
        "revenue_per_minute": _on_purchases(lambda p: revenue.revenue_by_window(p, "1 minute")),
        "revenue_per_hour": _on_purchases(lambda p: revenue.revenue_by_window(p, "1 hour")),
        "revenue_by_week": _on_purchases(lambda p: revenue.revenue_by_period(p, "week")),
        "revenue_by_month": _on_purchases(lambda p: revenue.revenue_by_period(p, "month")),
        "revenue_by_year": _on_purchases(lambda p: revenue.revenue_by_period(p, "year")),
        "active_users_sliding": _on_events(active_users.active_users_sliding, names=False),
        "active_user_sessions": _on_events(active_users.global_sessions, names=False),
        "active_users_now": _on_events(active_users.active_users_now, names=False),
        "kpi_trend": _on_events(trend.kpi_trend, names=False),
        # order-dependent lists
        "revenue_running": _on_purchases(revenue.revenue_running),
        "revenue_history": _on_purchases(revenue.revenue_history),
        "recent_events": _named_feed(feed.recent_events),
        "feed_age": _named_feed(feed.feed_age),
        # composites
        "kpis": _on_events(dashboard.kpis, names=False),
        "kpi_text": _on_events(dashboard.kpi_text, names=False),
        "dashboard": _named_feed(dashboard.dashboard),
        "dashboard_json": _named_feed(dashboard.dashboard_json),
        "stream_dashboard": _stream_dashboard,
        "dashboard_payload": _dashboard_payload,
        "dashboard_timeline": _dashboard_timeline,
        # wire format, validation, sources
        "kafka_rows": _kafka_rows,
        "kafka_partitions": _kafka_partitions,
        "archive_user_history": _archive_user_history,
        "wire_field_profile": _wire_field_profile,
        "parse_events": _parse_events,
        "valid_events": _valid_events,
        "rejected_events": _rejected_events,
        "lenient_events": _lenient_events,
        "lenient_missing_fields": _lenient_missing_fields,
        "dedup_missing_ids": _dedup_missing_ids,
        "bad_amounts": _bad_amounts,
        "ingest_reasons": _ingest_reasons,
        "ingest_defaults": _ingest_defaults,
        # enrichment
        "enriched_events": _enriched,
        # the sales view (order lines as purchases): volume and multi-year periods
        "sales_revenue_total": _on_sales(revenue.revenue_total, False, False),
        "sales_top_products": _sales_top_products,
        "sales_revenue_by_week": _sales_by_period("week"),
        "sales_revenue_by_month": _sales_by_period("month"),
        "sales_revenue_by_year": _sales_by_period("year"),
        "sales_trend": _sales_trend,
        # replayed streams
        **streams.queries(),
    }
