"""Enrichment (D8): product attributes joined onto events by product id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .joins import join_dimension


def enrich_events(events: DataFrame, part: DataFrame, fill_names: bool = False) -> DataFrame:
    """Left join of ``part`` attributes on ``product_id = p_partkey``.

    Every event is kept once (``p_partkey`` is the part key).  ``part`` is
    broadcast only below the size limit; beyond it the planner shuffles both
    sides and AQE splits a hot product's partition.  ``fill_names`` also takes
    a missing ``product_name`` from the same join (one join instead of two
    when the events come without names).
    """
    attrs = part.select(F.col("p_partkey"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    keyed = events.withColumn("_pk", F.col("product_id").try_cast("bigint"))
    joined = join_dimension(keyed, attrs, keyed["_pk"] == attrs["p_partkey"], how="left")
    if fill_names:
        joined = joined.withColumn("product_name", F.coalesce(F.col("product_name"), F.col("p_name")))
    return joined.select("event_id", "event_type", "user_id", "product_id", "product_name",
                         "price", "quantity", "ts",
                         F.col("p_brand").alias("brand"), F.col("p_type").alias("product_type"),
                         F.col("p_size").alias("size"), F.col("p_retailprice").alias("retail_price"))
