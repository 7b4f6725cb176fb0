"""Hand-made micro-fixtures (FIXTURES.md section 6) with their expected rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from shopstream.operators import active_users, counts, feed, products, revenue
from shopstream.operators.events import purchases, with_amount
from shopstream.plans.dashboard import dashboard
from shopstream.sources import json_events as wire

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def raw(spark, *records):
    lines = [r if isinstance(r, str) else json.dumps(r) for r in records]
    return spark.createDataFrame([(x,) for x in lines], "value string")


def ev(**kw):
    base = {"event_id": "e1", "event_type": "purchase_completed", "user_id": "u1",
            "product_id": "p1", "product_name": "Lamp", "price": 10, "quantity": 1,
            "timestamp": "2024-01-01T12:00:00"}
    base.update(kw)
    return {k: v for k, v in base.items() if v is not ...}


def lenient(spark, *records):
    return wire.parse_lenient(raw(spark, *records)).withColumn("seq", F.monotonically_increasing_id())


def test_missing_quantity_means_one(spark):
    df = lenient(spark, ev(quantity=...))
    assert with_amount(df).select("amount").first()[0] == 10.0


def test_missing_price_lenient_is_zero(spark):
    df = lenient(spark, ev(price=...))
    assert with_amount(df).select("amount").first()[0] == 0.0


@pytest.mark.parametrize("bad", [None, "abc"])
def test_null_or_text_price_counts_but_adds_nothing(spark, bad):
    df = lenient(spark, ev(price=bad), ev(event_id="e2", event_type="cart_added"))
    c = counts.event_counts(df).first()
    assert c["purchase_completed"] == 1 and c["total"] == 2
    assert counts.revenue_total(df).first()["total_revenue"] == 0.0
    assert products.product_counts(purchases(df)).count() == 0
    assert [r["id"] for r in feed.recent_events(df).collect()] == ["e2"]
    rej = wire.rejected_events(raw(spark, ev(price=bad))).first()
    assert "invalid_price" in rej["reasons"]


def test_numeric_text_price_accepted(spark):
    assert with_amount(lenient(spark, ev(price="1.5"))).select("amount").first()[0] == 1.5
    assert wire.valid_events(raw(spark, ev(price="1.5"))).select("price").first()[0] == 1.5


def test_unknown_type_counted_in_total_only(spark):
    df = lenient(spark, ev(event_type="refund"), ev(event_id="e2"))
    c = counts.event_counts(df).first()
    assert c["total"] == 2 and c["purchase_completed"] == 1
    by_type = {r["event_type"]: r["event_count"] for r in counts.events_by_type(df).collect()}
    assert by_type == {"refund": 1, "purchase_completed": 1}
    assert wire.rejected_events(raw(spark, ev(event_type="refund"))).first()["reasons"] == \
        "invalid_event_type_value"


def test_extra_field_dropped(spark):
    out = wire.valid_events(raw(spark, ev(session_id="s-1")))
    assert "session_id" not in out.columns and out.count() == 1


def test_broken_json_goes_to_reject_channel(spark):
    r = raw(spark, "{bad", ev())
    assert wire.parse_lenient(r).count() == 1
    assert [x["reasons"] for x in wire.lenient_rejects(r).collect()] == ["malformed_json"]
    assert wire.rejected_events(r).first()["reasons"] == "malformed_json"


def test_fractional_quantity(spark):
    assert lenient(spark, ev(quantity=2.5)).select("quantity").first()[0] == 2
    rej = wire.rejected_events(raw(spark, ev(quantity=2.5))).first()
    assert rej["reasons"] == "invalid_quantity"
    assert wire.valid_events(raw(spark, ev(quantity=2.0))).select("quantity").first()[0] == 2


def test_negative_quantity_lowers_revenue(spark):
    df = lenient(spark, ev(quantity=-1), ev(event_id="e2", price=5))
    assert counts.revenue_total(df).first()["total_revenue"] == -5.0
    assert wire.valid_events(raw(spark, ev(quantity=-1))).count() == 1


def test_strict_defaults(spark):
    row = wire.valid_events(raw(spark, ev(event_id=..., quantity=..., timestamp=...))).first()
    assert row["event_id"] and row["quantity"] == 1 and row["ts"] is not None
    assert row["metadata"] == {}


def test_strict_rejects_number_for_string(spark):
    rej = wire.rejected_events(raw(spark, ev(user_id=7))).first()
    assert rej["reasons"] == "invalid_user_id"
    rej = wire.rejected_events(raw(spark, ev(user_id=...))).first()
    assert rej["reasons"] == "missing_user_id"


def test_top_products_tie_breaks_by_name_descending(spark):
    df = lenient(spark, ev(product_name="Apple"), ev(event_id="e2", product_name="Banana"))
    top = [r["product_name"] for r in products.top_products(purchases(df)).collect()]
    assert top == ["Banana", "Apple"]


@pytest.mark.parametrize("gap,sessions", [(299, 1), (300, 2), (301, 2)])
def test_session_gap_edges(spark, gap, sessions):
    t1 = T0 + dt.timedelta(seconds=gap)
    df = lenient(spark, ev(event_type="product_viewed", user_id="a"),
                 ev(event_id="e2", event_type="product_viewed", user_id="b", timestamp=t1.isoformat()))
    got = active_users.global_sessions(df).collect()
    assert len(got) == sessions
    now = active_users.active_users_now(df).first()["active_users"]
    assert now == (2 if sessions == 1 else 1)


def test_sessions_across_midnight_and_many_days(spark):
    times = [dt.datetime(2024, 1, 1, 23, 58), dt.datetime(2024, 1, 2, 0, 2), dt.datetime(2024, 1, 2, 0, 6),
             dt.datetime(2024, 1, 5, 10, 0), dt.datetime(2024, 1, 5, 10, 4, 59)]
    df = lenient(spark, *[ev(event_id=f"e{i}", user_id=f"u{i % 2}", timestamp=t.isoformat())
                          for i, t in enumerate(times)])
    got = sorted((r["session_start"], r["active_users"], r["events"])
                 for r in active_users.global_sessions(df).collect())
    assert got == [(times[0], 2, 3), (times[3], 2, 2)]


def test_empty_input_gives_zeros_and_empty_lists(spark):
    df = lenient(spark, ev(event_type="product_viewed")).where(F.lit(False))
    row = dashboard(df).first()
    assert row["revenue"]["total_revenue"] == 0.0
    assert row["event_counts"]["total"] == 0
    assert row["active_users"]["active_users"] == 0
    assert row["recent_events"] == [] and row["revenue_history"] == []
    assert row["top_products"]["products"] == []


def test_short_history_and_running_total(spark):
    df = lenient(spark, *[ev(event_id=f"e{i}", price=i, timestamp=(T0 + dt.timedelta(seconds=i)).isoformat())
                          for i in range(1, 4)])
    hist = [(r["name"], r["revenue"]) for r in revenue.revenue_history(purchases(df)).orderBy("ts").collect()]
    assert hist == [("12:00:01", 1.0), ("12:00:02", 3.0), ("12:00:03", 6.0)]
    run = [r["cumulative_revenue"] for r in revenue.revenue_running(purchases(df), 2).orderBy("ts").collect()]
    assert run == [1.0, 3.0, 6.0]


def test_large_amount_text(spark):
    df = lenient(spark, ev(price=134900, quantity=100))
    assert feed.recent_events(df).first()["subtitle"] == "Lamp - ₹13490000.0"


def test_duplicate_event_counted_twice_unless_deduplicated(spark):
    from shopstream.operators.events import dedupe_events
    df = lenient(spark, ev(), ev())
    assert counts.event_counts(df).first()["total"] == 2
    assert counts.event_counts(dedupe_events(df)).first()["total"] == 1
    assert counts.revenue_total(dedupe_events(df)).first()["total_revenue"] == 10.0


def test_adapter_produces_the_canonical_schema(spark):
    from conftest import SF_SMALL
    from shopstream.schema import CANONICAL_SCHEMA
    from shopstream.sources.adapters import shop_events
    got = [(f.name, f.dataType.simpleString()) for f in shop_events(spark, SF_SMALL).schema.fields]
    assert got == [(f.name, f.dataType.simpleString()) for f in CANONICAL_SCHEMA.fields]


def test_strict_timestamp_numbers_seconds_or_milliseconds(spark):
    rows = wire.valid_events(raw(spark, ev(timestamp=1704110400), ev(event_id="e2", timestamp=1704110400000)))
    assert sorted(r["ts"] for r in rows.collect()) == [T0, T0]
