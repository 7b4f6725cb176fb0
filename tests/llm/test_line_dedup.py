"""Line deduplication against a direct computation, with borders of the hash ranges in every place."""

from __future__ import annotations

import hashlib
import random

import cases
import pytest
from pyspark.sql import functions as F

from shopstream.llm import line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def expected(rows):
    """(doc_id, n_lines, n_dropped, text that stays) of each row."""
    last = float("inf")
    owner = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            owner[k] = min(owner.get(k, last), last if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == (last if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(df):
    got = line_dedup.deduplicated(df).select("doc_id", "n_lines", "n_dropped", "text")
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_common_line_over_many_ranges(spark, partitions):
    rng = random.Random(partitions)
    common = ["The very common LINE ", "another shared line", "é" * 9, "é" * 10, "short", "ß-ẞ ÄÖÜ shared"]
    rows = []
    for i in range(300):
        lines = [rng.choice(common) for _ in range(rng.randrange(5))] + [f"own line number {rng.randrange(200)}"]
        rng.shuffle(lines)
        rows.append((rng.choice([i, i, i % 50, None]), "\n".join(lines)))
    rows += [(5, None), (6, ""), (None, None), (7, "\n\n"), (8, "  The very common line\t\n" * 3), (8, "  The very common line\t\n" * 3)]
    rows += [(-3, "the very common line"), (2 ** 62, "\n".join(["x" * 40] * 5000 + ["another shared line"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(df) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_line_in_every_document_spans_partitions(spark):
    rows = [(i, "this line is everywhere\n" * 2 + "and a second one") for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert found(df) == expected(rows)
        assert line_dedup.dropped_lines(df).count() == 399 * 3
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_awkward_tables(spark):
    rows = cases.documents()
    df = cases.frame(spark, rows, extra=True).withColumn("keep", F.lit("x")).withColumn("n_lines", F.lit(7))
    assert found(df) == expected([(r[0], r[1]) for r in rows])
    assert found(cases.frame(spark, []).limit(0)) == []


def test_bitmaps_are_compressed_and_whole(spark):
    text = "\n".join(f"line number {i:09d}" for i in range(20000))
    df = spark.createDataFrame([(1, text), (2, text + "\nonly here, not above")], "doc_id long, text string")
    row = line_dedup.line_bitmaps(df).first()
    assert (row["doc_id"], row["n_dropped"], row["last"]) == (2, 20000, 19999)
    assert len(row["keep"]) < 200
    assert list(line_dedup.keep_bits(row["keep"], row["last"] + 1, 20001)) == [False] * 20000 + [True]


def test_query_hashes_the_kept_text(spark):
    got = line_dedup.op13_line_dedup(spark, "/root/testdata/sf0.001").collect()
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, x, hashlib.sha256(t.encode()).hexdigest()) for d, n, x, t in expected(docs)]
    assert sorted(tuple(r) for r in got) == sorted(want)
