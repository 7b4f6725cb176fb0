"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table

# Characters that end a word, and the regular expression of a run of them.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

FOLDS = 5

# A lookup table within both bounds is broadcast; any other is joined by a salted shuffle.
BROADCAST_ROWS, BROADCAST_KEY_BYTES = 20_000, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table with only the columns an operator reads."""
    return read_table(spark, sf_dir, name).select(*columns)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo five; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0))


# Spark removes a query's shuffle files at its end where this was set when its plan was made.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """The same rows, written to the shared checkpoint folder; later reads survive lost executors.

    With ``drop_shuffles`` the shuffle files made on the way are removed as soon as the rows are written,
    not when the driver collects garbage.  Nothing reads them again: the result's lineage is cut.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not drop_shuffles:
        return df.checkpoint(eager=True)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps.

    Spark's cleaner removes them once the driver has collected the objects that own them, which a driver
    with free memory does late; a job of several large steps would keep all their files on disk.
    """
    gc.collect()
    if (jvm := getattr(spark, "_jvm", None)) is not None:
        jvm.System.gc()


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, spread: Column, salts: int = 16) -> DataFrame:
    """Left join of ``lookup`` (one row per ``key``) onto ``rows``; null keys meet null keys.

    A lookup table that has been counted and is small is broadcast.  Otherwise a hot key is dealt over
    ``salts`` tasks; ``spread`` is any well spread column of ``rows``.
    """
    lookup = settled(lookup)
    n, size = lookup.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(key).cast("string")))).first()
    if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_KEY_BYTES:
        right = F.broadcast(lookup.withColumnRenamed(key, "_lookup_key"))
        return rows.join(right, F.col(key).eqNullSafe(F.col("_lookup_key")), "left").drop("_lookup_key")
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    right = lookup.withColumnRenamed(key, "_lookup_key").withColumn(
        "_lookup_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    same = (F.col("_salt") == F.col("_lookup_salt")) & F.col(key).eqNullSafe(F.col("_lookup_key"))
    return left.join(right, same, "left").drop("_salt", "_lookup_salt", "_lookup_key")


def at_least(n: int, df: DataFrame) -> int:
    """Shuffle partitions for a keyed stage: the session's setting, ``n`` at least."""
    return max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
