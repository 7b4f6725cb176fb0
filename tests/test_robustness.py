"""Awkward input: missing ids and times, ties, late rows, bad amounts, old state, other time zones."""

import datetime as dt
import json
import os
import uuid

import pytest
from conftest import SF_SMALL
from oracle_compare import compare_all

from shopstream.operators import active_users, revenue, trend
from shopstream.operators.events import dedupe_events, purchases
from shopstream.plans import catalog, dashboard, streams
from shopstream.sources import json_events as wire
from shopstream.streaming import processor

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def line(i, kind="product_viewed", at=0, user="u", **more):
    ts = (T0 + dt.timedelta(seconds=at)).isoformat() if at is not None else None
    event = {"event_id": str(i) if i is not None else None, "event_type": kind, "user_id": user, "price": 1.0,
             "quantity": 1, "timestamp": ts, "product_name": "p", **more}
    return json.dumps({k: v for k, v in event.items() if v is not None})


def replay(spark, folder, files, **options):
    """The processor over files of lines, one per micro-batch."""
    src = os.path.join(folder, "src")
    os.makedirs(src, exist_ok=True)
    for k, lines in enumerate(files):
        path = os.path.join(src, f"f{k}.json")
        with open(path, "w") as fh:
            fh.write("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    state = os.path.join(folder, "state")
    processor.start_processor(wire.stream_json_lines(spark, src, 1), state, os.path.join(folder, "ckpt"),
                              available_now=True, **options).awaitTermination()
    return state


def test_dedup_loses_nothing(spark, scratch):
    files = [[line(1), line(None), line(None), "{bad", line(1)], [line(2, at=4000), line(1)], [line(3, at=10), line(None)]]
    once = replay(spark, os.path.join(scratch, "a"), files, dedup=True)
    assert processor.snapshot_dashboard(spark, once).first()["event_counts"]["total"] == 6
    assert spark.read.parquet(os.path.join(once, "rejects")).count() == 1
    every = replay(spark, os.path.join(scratch, "b"), files)
    assert processor.snapshot_dashboard(spark, every).first()["event_counts"]["total"] == 8


def test_late_rows_and_ties_equal_the_batch(spark, scratch):
    buy = {"kind": "purchase_completed"}
    files = [[line(8, at=0, user="a", **buy), line(9, at=0, user="b", **buy)],
             [line(10, at=0, user="c", **buy), line(11, at=290, user="a", **buy)],
             [line(12, at=10, user="d", **buy), line(13, "cart_added", at=400, user="b")],
             [line(14, at=400, user="e", **buy)]]
    state = replay(spark, scratch, files)
    rows = [(n, x) for n, x in enumerate(x for f in files for x in f)]
    batch = wire.lenient_from_decoded(wire.decode(spark.createDataFrame(rows, "seq long, value string")), None, ("seq",))
    got, want = processor.snapshot_dashboard(spark, state).first(), dashboard.dashboard(batch).first()
    assert got.asDict(recursive=True) == want.asDict(recursive=True)
    assert got["active_users"]["active_users"] == 5
    assert [e["id"] for e in got["recent_events"]] == ["14", "13", "11", "12", "10", "9", "8"]
    assert spark.read.parquet(os.path.join(state, "sessions")).count() == 0


def test_state_keeps_open_members_and_two_versions(spark, scratch):
    files = [[line(10 * k + i, at=1000 * k, user=f"u{k}-{i}") for i in range(3)] for k in range(5)]
    state = replay(spark, scratch, files)
    assert spark.read.parquet(os.path.join(state, "users", "v=4")).count() == 3
    assert sorted(os.listdir(os.path.join(state, "users"))) == ["v=3", "v=4"]
    assert spark.read.parquet(os.path.join(state, "sessions")).count() == 4
    # a new checkpoint doesn't restart on old state
    with pytest.raises(Exception, match="another checkpoint"):
        processor.start_processor(wire.stream_json_lines(spark, os.path.join(scratch, "src"), 1), state,
                                  os.path.join(scratch, "new"), available_now=True).awaitTermination()


def test_decoding_of_odd_fields(spark):
    def read(text):
        return wire.parse_lenient(spark.createDataFrame([(text,)], "value string")).first()

    wide = read('{"event_type":"purchase_completed","price":1,"quantity":3000000000}')
    assert wide["quantity"] == 3_000_000_000 and wide["event_id"] is None
    assert abs((wide["ts"] - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).total_seconds()) < 600
    assert read('{"event_id":"a","event_id":"b"}')["event_id"] == "b"
    assert read('{"timestamp":1704110400}')["ts"] == T0 == read('{"timestamp":"1704110400"}')["ts"]
    strict = wire.valid_events(spark.createDataFrame([(line(1, timestamp="1704110400", product_id="7", price=True),)], "value string")).first()
    assert strict["ts"] == T0 and strict["price"] == 1.0


def test_times_do_not_depend_on_the_session_zone(spark):
    texts = ["2024-01-01T12:00:00Z", "2024-01-01T14:00:00+02:00", "2024-03-10T02:30:00", "1704110400"]
    raw = spark.createDataFrame([(json.dumps({"timestamp": t}),) for t in texts], "value string")
    want = [T0, T0, dt.datetime(2024, 3, 10, 2, 30), T0]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r["ts"] for r in wire.parse_lenient(raw).collect()] == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def events(spark, rows):
    return spark.createDataFrame(rows, "seq long, event_id string, event_type string, user_id string, product_name string, "
                                       "price double, quantity long, ts timestamp_ntz, metadata map<string,string>")


def test_amounts_beyond_all_bounds(spark):
    rows = [(i, str(i), "purchase_completed", "u", "p", p, 1, T0 + dt.timedelta(seconds=i), None)
            for i, p in enumerate([1e13, 1e13, float("nan"), float("inf"), 1e40, 2.5])]
    ev = events(spark, rows)
    assert dashboard.kpis(ev).first()["revenue"] == 2e13 + 2.5
    assert dashboard.kpis(ev).first()["total_events"] == 6
    got = revenue.revenue_running(purchases(ev), partitions=2).orderBy("ts").collect()
    assert [r["cumulative_revenue"] for r in got] == [1e13, 2e13, 2e13 + 2.5]
    assert [r["revenue"] for r in revenue.revenue_history(purchases(ev)).collect()] == [1e13, 2e13, 2e13 + 2.5]


def test_trend_compares_calendar_neighbours_only(spark):
    day = dt.timedelta(days=1)
    rows = [(i, str(i), "purchase_completed", "u", "p", p, 1, T0 + d * day, None) for i, (d, p) in enumerate([(0, 10.0), (4, 15.0), (5, 30.0)])]
    got = trend.kpi_trend(events(spark, rows)).orderBy("period_start").collect()
    assert [r["revenue_trend"] for r in got] == [None, None, "+100.0%"]


def test_dedupe_keeps_the_first_delivery(spark):
    rows = [(3, "a", "cart_added", "u", "p", 1.0, 1, T0, {"k": "3"}), (1, "a", "product_viewed", "u", "p", 1.0, 1, T0, None),
            (2, None, "x", "u", "p", 1.0, 1, T0, None), (4, None, "x", "u", "p", 1.0, 1, T0, None)]
    got = dedupe_events(events(spark, rows)).orderBy("seq").collect()
    assert [(r["seq"], r["event_type"]) for r in got] == [(1, "product_viewed"), (2, "x"), (4, "x")]


def jobs_of(spark, build):
    tracker = spark.sparkContext.statusTracker()
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        build()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_building_a_query_reads_schemas_only(spark):
    spark.conf.set("shopstream.broadcast.maxBytes", "1")
    try:
        for name, query in catalog.queries().items():
            # these write checkpoints or a stream's source; the profile looks for the deepest level of the messages
            if name not in ("revenue_running", "stream_dashboard", "dashboard_timeline", "wire_field_profile", "archive_user_history", *streams.queries()):
                assert jobs_of(spark, lambda q=query: q(spark, SF_SMALL)) <= 3, name
    finally:
        spark.conf.unset("shopstream.broadcast.maxBytes")


def scans(df):
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan is not None
    return text


def test_sessions_scan_the_events_once(spark):
    from shopstream.sources.adapters import shop_events
    text = scans(active_users.global_sessions(shop_events(spark, SF_SMALL, with_names=False)))
    assert "ReusedExchange" in text or text.count("FileScan parquet") == 1


@pytest.mark.parametrize("names", [["kpis", "dashboard", "top_products", "sales_revenue_by_month", "sales_top_products", "recent_events",
                                    "enriched_events", "active_user_sessions", "product_counts", "sales_trend"]])
def test_large_dimensions_give_the_same_results(spark, names):
    spark.conf.set("shopstream.broadcast.maxBytes", "1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [r for r in compare_all(spark, SF_SMALL, names) if r["status"] != "match"] == []
    finally:
        spark.conf.unset("shopstream.broadcast.maxBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_local_masters_only_get_a_scratch_folder():
    from shopstream.session import ensure_checkpoint_dir

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
