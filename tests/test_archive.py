"""Archive lookups against a plain filter; what the plan and the files let Spark skip."""

import datetime as dt
import os

import duckdb
from conftest import SF_SMALL
from oracle_compare import compare_all

from shopstream.sources import archive

DAY = dt.date(2024, 5, 3)


def stored(spark, scratch):
    rows = [(i, f"e{i}", "hot" if i % 3 == 0 else f"u{i % 40}" if i % 7 else None,
             dt.datetime(2024, 5, 1 + i % 5, i % 24) if i % 11 else None) for i in range(400)]
    path = os.path.join(scratch, "archive")
    archive.compact(spark.createDataFrame(rows, "seq long, event_id string, user_id string, ts timestamp_ntz"), path)
    return rows, path


def test_lookups_equal_a_plain_filter(spark, scratch):
    rows, path = stored(spark, scratch)
    events = archive.read_archive(spark, path)
    assert sorted(r["seq"] for r in events.collect()) == [r[0] for r in rows]          # nothing is lost
    for users in (["u1"], ["hot", "u5"], ["nobody"], []):
        got = archive.user_history(events, users, DAY, DAY + dt.timedelta(days=1)).collect()
        want = [r[0] for r in rows if r[2] in users and r[3] and DAY <= r[3].date() <= DAY + dt.timedelta(days=1)]
        assert sorted(r["seq"] for r in got) == want
    counts = {}
    for _, _, user, ts in rows:
        if ts and ts.date() == DAY and user:
            counts[user] = counts.get(user, 0) + 1
    assert archive.busiest_users(events, DAY, 4) == sorted(counts, key=lambda u: (-counts[u], u))[:4]


def test_days_and_bloom_filters_are_used(spark, scratch):
    # Parquet writes Bloom filters where a file has too many users for a dictionary, which serves else
    path = os.path.join(scratch, "archive")
    many = spark.range(300_000).selectExpr("id AS seq", "md5(string(id)) AS user_id", "timestamp_ntz '2024-05-03 10:00:00' AS ts")
    archive.compact(many, path)
    found = archive.user_history(archive.read_archive(spark, path), ["cfcd208495d565ef66e7dff9f98764da"], DAY, DAY)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "EqualTo(user_id,cfcd208495d565ef66e7dff9f98764da)" in plan
    assert [r["seq"] for r in found.collect()] == [0]
    files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    offsets = duckdb.sql(f"SELECT bloom_filter_offset FROM parquet_metadata({files}) WHERE path_in_schema = 'user_id'").fetchall()
    assert offsets and any(o for o, in offsets)


def test_query_equals_its_sql(spark):
    result, = compare_all(spark, SF_SMALL, ["archive_user_history"])
    assert result["status"] == "match", result
