"""Product ranking: purchase counts per product name, top-k, percent of max."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import TOP_PRODUCTS_LIMIT, UNKNOWN
from .events import product_key
from .joins import fits_broadcast, join_dimension


def product_counts(purchases: DataFrame) -> DataFrame:
    """A5: number of purchase events per product name (quantity ignored).

    Hash aggregate with map-side partial counts: a product holding a third of
    all purchases becomes one partial row per map task, not a hot reducer.
    """
    return (purchases.groupBy(product_key().alias("product_name"))
            .agg(F.count(F.lit(1)).alias("purchase_count")))


def product_counts_by_id(purchases: DataFrame, names: DataFrame, id_col: str = "product_id",
                         key_col: str = "p_partkey", name_col: str = "p_name") -> DataFrame:
    """A5 with the aggregation pushed below the name join (eager aggregation).

    When the name table is too big to broadcast, purchases are first counted
    per product *id* (partial counts map-side), so the shuffle join with the
    name table sees one row per product instead of one per purchase; the
    per-name total is then a sum over those rows.  A broadcastable name table
    is simply looked up per purchase.  Equal to ``product_counts`` on
    purchases joined to ``names``.
    """
    dims = names.select(F.col(key_col).alias("_key"), F.col(name_col).alias("_name"))
    name_of = F.coalesce(F.col("_name"), F.lit(UNKNOWN)).alias("product_name")
    if fits_broadcast(dims):
        # small name table: one broadcast lookup per purchase, one aggregate
        keyed = purchases.withColumn("_pid_key", F.col(id_col).try_cast(dims.schema["_key"].dataType))
        named = keyed.join(F.broadcast(dims), keyed["_pid_key"] == dims["_key"], "left")
        return named.groupBy(name_of).agg(F.count(F.lit(1)).alias("purchase_count"))
    per_id = (purchases.groupBy(F.col(id_col).alias("_pid"))
              .agg(F.count(F.lit(1)).alias("_n")))
    keyed = per_id.withColumn("_pid_key", F.col("_pid").try_cast(dims.schema["_key"].dataType))
    named = join_dimension(keyed, dims, keyed["_pid_key"] == dims["_key"], how="left", limit=0)  # measured already
    return named.groupBy(name_of).agg(F.sum("_n").alias("purchase_count"))


def top_by_count(counts: DataFrame, n: int = TOP_PRODUCTS_LIMIT) -> DataFrame:
    """L1 over ready counts: count descending, name descending on ties."""
    return counts.orderBy(F.desc("purchase_count"), F.desc("product_name")).limit(n)


def top_products(purchases: DataFrame, n: int = TOP_PRODUCTS_LIMIT) -> DataFrame:
    """L1: the n best sellers, ties broken by name descending.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    its own top n, so no global sort of the product table happens.
    """
    return (product_counts(purchases)
            .orderBy(F.desc("purchase_count"), F.desc("product_name"))
            .limit(n))


def top_products_percent(purchases: DataFrame, n: int = TOP_PRODUCTS_LIMIT,
                         top: DataFrame | None = None) -> DataFrame:
    """Top-n as ``(name, sales, percent)``, percent of the best seller.

    The window spans only the n rows left after the top-k.
    """
    top = top if top is not None else top_products(purchases, n)
    best = F.greatest(F.max("purchase_count").over(Window.partitionBy()), F.lit(1))
    return top.select(
        F.col("product_name").alias("name"),
        F.col("purchase_count").alias("sales"),
        (F.col("purchase_count") / best * 100).alias("percent"),
    )
