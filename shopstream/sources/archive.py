"""The event archive as a lookup table (S5): date partitions, sorted by user, with Bloom filters on the user id.

A lookup of users in a span of days lists only those days' partitions; within them Parquet skips the row
groups whose statistics, dictionary or (where users are too many for one) Bloom filter exclude every user
asked for.  Rows without a time lie in a partition
of their own and rows without a user id match no user: both are archived, neither is ever found by a lookup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

USERS_PER_FILE = 1_000_000     # distinct users that a file's Bloom filters are sized for
PUSHED_USERS = 10              # more users at once are looked up by ranges, not by Bloom filter


def compact(events: DataFrame, path: str, users_per_file: int = USERS_PER_FILE) -> None:
    """Write ``events`` by day, in files that are ranges of (day, user).

    The ranges end with ``seq``, so a busy day or user is spread over several files.
    """
    (events.withColumn("event_date", F.to_date("ts"))
     .repartitionByRange("event_date", "user_id", "seq")
     .sortWithinPartitions("event_date", "user_id", "seq")
     .write.partitionBy("event_date")
     .option("parquet.bloom.filter.enabled#user_id", "true")
     .option("parquet.bloom.filter.expected.ndv#user_id", str(users_per_file))
     .option("parquet.bloom.filter.adaptive.enabled", "true")     # as small as the file's users allow
     .parquet(path))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def user_history(archive: DataFrame, users: Sequence[str], first_day, last_day) -> DataFrame:
    """Events of ``users`` (a short list) from ``first_day`` to ``last_day``, both included."""
    return archive.where(F.col("event_date").between(F.lit(first_day), F.lit(last_day)) & F.col("user_id").isin(*users))


def busiest_users(archive: DataFrame, day, n: int = PUSHED_USERS) -> list[str]:
    """The ``n`` users with the most events of a day, the smaller id first among equals."""
    per_user = archive.where((F.col("event_date") == F.lit(day)) & F.col("user_id").isNotNull()).groupBy("user_id").count()
    return [r["user_id"] for r in per_user.orderBy(F.desc("count"), "user_id").limit(n).collect()]
