"""Adapters from the driver tables to shop events.

* ``shop_events``: canonical events from ``events`` + ``part`` (adapter A).
* ``sales``: one purchase per order line from ``lineitem`` + ``orders`` +
  ``part`` (adapter B), for volume and multi-year periods.  It has no row key,
  so it only feeds order-independent metrics (sums, counts, top-k, periods).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.joins import join_dimension
from ..schema import PURCHASE_COMPLETED, SOURCE_TYPE_MAP
from .tables import read_table


def map_source_type(col: Column) -> Column:
    """Driver event type -> shop event type; unknown types pass through."""
    mapped = None
    for src, dst in SOURCE_TYPE_MAP.items():
        mapped = (F.when(col == src, F.lit(dst)) if mapped is None
                  else mapped.when(col == src, F.lit(dst)))
    return mapped.otherwise(col)


def source_types_for(wanted) -> list[str]:
    """Driver type names that become one of ``wanted`` (unmapped names pass
    through unchanged, so a wanted name is also its own source name)."""
    wanted = set(wanted)
    return sorted({src for src, dst in SOURCE_TYPE_MAP.items() if dst in wanted}
                  | {t for t in wanted if t not in SOURCE_TYPE_MAP})


def events_to_shop_events(events: DataFrame, part: DataFrame | None, map_types: bool = True,
                          only_types=None) -> DataFrame:
    """Canonical events (see ``schema.CANONICAL_SCHEMA``) from the driver tables.

    * ``map_types=False`` keeps the driver's own type names (view, click, ...),
      i.e. events as an unconverted client would send them.
    * ``only_types``: keep only these canonical types; the filter is written
      on the source column so it reaches the parquet scan.
    * ``part=None`` skips the product-name join (``product_name`` is null) for
      metrics that never read names.
    """
    if only_types is not None:
        keep = source_types_for(only_types) if map_types else sorted(set(only_types))
        events = events.where(F.col("event_type").isin(*keep))
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    typed = events.select(
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("event_id"),
        (map_source_type(F.col("event_type")) if map_types else F.col("event_type")).alias("event_type"),
        F.col("user_id").cast("string").alias("user_id"),
        k.alias("k"),
        F.col("value").alias("price"),
        F.coalesce((F.lit(1) + k % 3).cast("bigint"), F.lit(1)).alias("quantity"),
        F.col("ts"),
    )
    if part is not None:
        names = part.select(F.col("p_partkey"), F.col("p_name"))
        joined = join_dimension(typed, names, typed["k"] == names["p_partkey"], how="left")
        name_col = F.col("p_name")
    else:
        joined, name_col = typed, F.lit(None).cast("string")
    return joined.select(
        "seq", "event_id", "event_type", "user_id",
        F.col("k").cast("string").alias("product_id"),
        name_col.alias("product_name"),
        "price", "quantity", "ts",
        F.when(F.col("k").isNotNull(),
               F.create_map(F.lit("k"), F.col("k").cast("string"))).alias("metadata"),
    )


def shop_events(spark: SparkSession, sf_dir: str, map_types: bool = True, only_types=None,
                with_names: bool = True) -> DataFrame:
    part = read_table(spark, sf_dir, "part") if with_names else None
    return events_to_shop_events(read_table(spark, sf_dir, "events"), part, map_types, only_types)


def sales(spark: SparkSession, sf_dir: str, with_date: bool = True,
          with_name: bool = True) -> DataFrame:
    """Purchases from order lines: ``(event_type, product_id, product_name,
    quantity, amount, ts)``.

    Both joins are left joins on unique dimension keys, so every line is kept
    exactly once; a metric that needs neither the date nor the name skips the
    join altogether (``with_date`` / ``with_name``).
    """
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    out = lines
    if with_date:
        orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
        # orders grows with lineitem: a plain shuffle join unless small.
        out = join_dimension(out, orders, out["l_orderkey"] == orders["o_orderkey"], "left")
    if with_name:
        part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
        out = join_dimension(out, part, out["l_partkey"] == part["p_partkey"], "left")
    return out.select(
        F.lit(PURCHASE_COMPLETED).alias("event_type"),
        F.col("l_partkey").cast("string").alias("product_id"),
        (F.col("p_name") if with_name else F.lit(None).cast("string")).alias("product_name"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        (F.col("o_orderdate") if with_date else F.lit(None).cast("timestamp_ntz")).alias("ts"),
    )
