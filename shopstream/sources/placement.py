"""Where the producer's keyed messages go: the public key hash of Kafka's default partitioner (S3).

A message's partition is the 32-bit murmur2 of its key's UTF-8 bytes, without its sign bit, modulo the number
of partitions.  Here it is one built-in expression, so the sink's placement, and thereby the order of each
user's events, can be computed, checked and kept inside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the public murmur2 function.
SEED = 0x9747B28C
MULTIPLIER = 0x5BD1E995

MASK = 0xFFFFFFFF            # 32-bit arithmetic in 64-bit integers: products stay below 2^63


def _times(x: Column) -> Column:
    return (x * F.lit(MULTIPLIER)).bitwiseAND(F.lit(MASK))


def _mixed(x: Column, shift: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, shift))


def murmur2(key: Column) -> Column:
    """Unsigned 32-bit murmur2 of a text's UTF-8 bytes; null for null."""
    digits, n = F.hex(F.encode(key, "UTF-8")), F.octet_length(key)
    whole = F.floor(n / 4).cast("int")

    def byte(i: Column) -> Column:
        """The byte at place i, two hex digits."""
        return F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")

    def word(i: Column) -> Column:
        four = [F.shiftleft(byte(i * 4 + j), 8 * j) for j in range(4)]
        return four[0] + four[1] + four[2] + four[3]

    def add(h: Column, i: Column) -> Column:
        return _times(h).bitwiseXOR(_times(_mixed(_times(word(i)), 24)))

    places = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(places, F.lit(SEED).bitwiseXOR(n.cast("bigint")), add)
    rest = [F.when(n % 4 > j, F.shiftleft(byte(whole * 4 + j), 8 * j)).otherwise(F.lit(0).cast("bigint")) for j in range(3)]
    h = F.when(n % 4 > 0, _times(h.bitwiseXOR(rest[0] + rest[1] + rest[2]))).otherwise(h)
    return _mixed(_times(_mixed(h, 13)), 15)


def partition_of(key: Column, partitions: int) -> Column:
    """The partition of a keyed message; null without a key (the producer then picks one itself).

    An empty key counts as none, as in the producer.
    """
    return F.when(F.length(key) > 0, (murmur2(key).bitwiseAND(F.lit(0x7FFFFFFF)) % partitions).cast("int"))


def placed(rows: DataFrame, partitions: int, order: list[str], key: str = "key") -> DataFrame:
    """Rows dealt to tasks as the topic deals them to partitions, each task's rows in ``order``.

    Rows with the same key keep their order on the way to the sink.  Keyless rows are spread by their order.
    """
    to = F.coalesce(partition_of(F.col(key), partitions), F.pmod(F.xxhash64(*order), F.lit(partitions)).cast("int"))
    return rows.withColumn("partition", to).repartition(partitions, "partition").sortWithinPartitions("partition", *order)
