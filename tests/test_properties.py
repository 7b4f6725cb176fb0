"""Property tests: the distributed algorithms against brute force on random input."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings, strategies as st

from shopstream.operators.active_users import active_users_now, global_sessions
from shopstream.operators.revenue import revenue_running

T0 = dt.datetime(2024, 1, 1, 23, 50, 0)
SCHEMA = ("seq bigint, event_id string, event_type string, user_id string, product_id string, "
          "product_name string, price double, quantity int, ts timestamp_ntz, metadata map<string,string>")

# offsets in seconds: clustered near the 300 s edge, with repeats and day crossings
gaps = st.lists(st.sampled_from([0, 0.5, 1, 150, 299, 299.999999, 300, 300.000001, 301, 900, 86_400]),
                min_size=1, max_size=40)
users = st.lists(st.sampled_from(["u1", "u2", "u3", None]), min_size=40, max_size=40)


def events_df(spark, offsets, who, prices=None):
    rows, t = [], T0
    for i, g in enumerate(offsets):
        t = t + dt.timedelta(seconds=g)
        price = prices[i] if prices else 1.0
        rows.append((i, f"e{i}", "purchase_completed", who[i % len(who)], None, None, price, 1, t, None))
    return spark.createDataFrame(rows, SCHEMA), rows


def brute_sessions(rows):
    out, cur = [], None
    for r in sorted(rows, key=lambda r: r[8]):
        ts, user = r[8], r[3] or "unknown"
        if cur is None or (ts - cur["last"]).total_seconds() >= 300:
            cur = {"start": ts, "last": ts, "users": set(), "n": 0}
            out.append(cur)
        cur["last"], cur["n"] = ts, cur["n"] + 1
        cur["users"].add(user)
    return sorted((c["start"], c["last"] + dt.timedelta(seconds=300), len(c["users"]), c["n"]) for c in out)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(offsets=gaps, who=users)
def test_global_sessions_match_brute_force(spark, offsets, who):
    df, rows = events_df(spark, offsets, who)
    got = sorted(tuple(r) for r in global_sessions(df).collect())
    want = brute_sessions(rows)
    assert got == want
    assert active_users_now(df).first()["active_users"] == want[-1][2]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(offsets=gaps, parts=st.integers(min_value=1, max_value=9),
       cents=st.lists(st.integers(min_value=-5_000, max_value=2_000_000), min_size=40, max_size=40))
def test_running_total_matches_prefix_sum(spark, offsets, parts, cents):
    prices = [c / 100 for c in cents]
    df, rows = events_df(spark, offsets, ["u1"], prices)
    got = [r["cumulative_revenue"] for r in
           revenue_running(df.withColumn("amount", df["price"]), parts).orderBy("ts", "event_id").collect()]
    acc, want = Decimal(0), []
    for r in sorted(rows, key=lambda r: (r[8], r[0])):
        acc += Decimal(str(r[6]))
        want.append(float(acc.quantize(Decimal("0.01"))))
    by_seq = sorted(zip(sorted(rows, key=lambda r: (r[8], r[0])), want), key=lambda p: (p[0][8], p[0][1]))
    assert got == [w for _, w in by_seq]
