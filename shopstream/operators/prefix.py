"""Prefix sums over a whole table, without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ensure_checkpoint_dir


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """``df`` with inclusive running sums (``sums``: name -> value) in the order of ``order``, a unique key.

    1. the rows are range-partitioned on the key: balanced whatever its values, and written to the checkpoint
       folder, so that all later uses read the very same ranges even if executors are lost;
    2. a window adds up inside each range;
    3. the totals of the ranges before it (at most ``partitions`` rows, broadcast) are added.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = "part"
    while part in df.columns:
        part = f"_{part}"
    values = {f"_v_{name}": value for name, value in sums.items()}
    placed = (df.withColumns(values).repartitionByRange(n, *order)
              .withColumn(part, F.spark_partition_id()).checkpoint(eager=True))
    totals = placed.groupBy(part).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(part).alias("_of"), *[F.sum(v).over(before).alias(f"_o{v}") for v in values])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumns({f"_s{v}": F.sum(v).over(inside) for v in values})
    rows = F.broadcast(offsets).join(rows, F.col(part) == F.col("_of"))
    return rows.select(*df.columns, *[
        (F.coalesce(F.col(f"_s_v_{name}"), F.lit(0)) + F.coalesce(F.col(f"_o_v_{name}"), F.lit(0))).alias(name)
        for name in sums])
