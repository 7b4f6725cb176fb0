"""The dashboard at many times against one dashboard per time; prefix sums against a plain loop."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shopstream.operators.prefix import running_sums
from shopstream.operators.revenue import revenue_running
from shopstream.plans import timeline
from shopstream.plans.dashboard import dashboard
from shopstream.plans.timeline import dashboard_timeline
from shopstream.schema import CANONICAL_SCHEMA, EVENT_TYPES

T0 = dt.datetime(2024, 3, 1, 10, 0, 0)
PARTS = [(i, f"name {i % 23}") for i in range(40)]


def shop(seed, n, hours):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        second = rng.randrange(hours * 3600) if rng.random() < 0.8 else 3600 * rng.randrange(hours) + rng.choice([0, 1, 3599])
        product = str(int(rng.paretovariate(1)) % 45) if rng.random() < 0.95 else None
        rows.append((i, f"e{i}", rng.choice([*EVENT_TYPES, "purchase_completed", "refund", None]), rng.choice(["a", "b", "c", "d", None]),
                     product, None, rng.choice([1.1, 20.25, None, float("nan")]) if rng.random() < 0.2 else 3.5, 1 + i % 3,
                     T0 + dt.timedelta(seconds=second), None))
    return rows


def norm(row):
    out = row.asDict(recursive=True)
    out.pop("as_of", None)
    return {k: ([] if v is None else v) for k, v in out.items()} | {"top_products": {"products": out["top_products"]["products"] or []}}


@pytest.mark.parametrize("seed,n,hours,chunks", [(1, 400, 9, 64), (2, 60, 14, 3), (3, 900, 6, 2)])
def test_every_hour_equals_its_own_dashboard(spark, monkeypatch, seed, n, hours, chunks):
    monkeypatch.setattr(timeline, "CHUNKS", chunks)
    rows = shop(seed, n, hours)
    events = spark.createDataFrame(rows + [(10_000, "x", "purchase_completed", "a", "1", None, 1.0, 1, None, None)], CANONICAL_SCHEMA)
    names = spark.createDataFrame(PARTS, "p_partkey long, p_name string")
    got = dashboard_timeline(events, names).orderBy("as_of").collect()
    first, last = min(r[8] for r in rows), max(r[8] for r in rows)
    want_times = []
    t = first.replace(minute=0, second=0)
    while t <= last:
        t += dt.timedelta(hours=1)
        want_times.append(t)
    assert [r["as_of"] for r in got] == want_times
    for r in random.Random(seed).sample(got, 4) + got[-1:]:
        before = events.where(F.col("ts") < F.lit(r["as_of"]))
        want = norm(dashboard(before, names).first())
        # the batch dashboard reads the session at its own newest event: here it is read at as_of
        newest = max(x[8] for x in rows if x[8] < r["as_of"])
        if r["as_of"] - newest >= dt.timedelta(seconds=300):
            want["active_users"] = {"active_users": 0, "window": "last 5 minutes"}
        assert norm(r) == want


def test_no_events(spark):
    events = spark.createDataFrame([], CANONICAL_SCHEMA)
    names = spark.createDataFrame(PARTS, "p_partkey long, p_name string")
    assert dashboard_timeline(events, names).collect() == []


@pytest.mark.parametrize("partitions", [1, 4, 9])
def test_running_sums(spark, partitions):
    rng = random.Random(partitions)
    rows = [(i, rng.choice([None, Decimal("0.100001"), Decimal("-3.5")]), rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, d decimal(38,6), x long").repartition(5)
    got = {r["i"]: (r["sd"], r["sx"]) for r in running_sums(df, ["i"], {"sd": F.col("d"), "sx": F.col("x")}, partitions).collect()}
    d, x = Decimal(0), 0
    for i, a, b in rows:
        d, x = d + (a or 0), x + b
        assert got[i] == (d, x)
    assert running_sums(df.limit(0), ["i"], {"sd": F.col("d")}).count() == 0


def test_running_revenue_runs_in_the_jvm(spark):
    paid = spark.createDataFrame([(1, "a", T0, 1.0)], "seq long, event_id string, ts timestamp_ntz, amount double")
    plan = revenue_running(paid)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_running_sums_keep_a_column_named_like_the_range(spark):
    df = spark.createDataFrame([(i, "x") for i in range(50)], "i long, part string")
    got = {r["i"]: (r["part"], r["s"]) for r in running_sums(df, ["i"], {"s": F.lit(1)}, 3).collect()}
    assert got == {i: ("x", i + 1) for i in range(50)}
