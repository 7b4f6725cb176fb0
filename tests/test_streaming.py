"""Stream = batch: the processor's snapshots equal the batch metrics; a
replayed batch does not double count; closed windows equal batch windows."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from shopstream.operators import active_users, revenue
from shopstream.operators.events import purchases
from shopstream.plans.dashboard import dashboard
from shopstream.sources import json_events as wire
from shopstream.sources.adapters import shop_events
from shopstream.streaming import processor, windows


def _write_json_files(spark, folder, parts=4):
    """The sf0.001 events as JSON lines, oldest first, one file per slice."""
    rows = wire.to_wire(shop_events(spark, SF_SMALL)).select(
        "value", F.get_json_object("value", "$.event_id").cast("long").alias("seq")).orderBy("seq")
    values = [r["value"] for r in rows.collect()]
    os.makedirs(folder)
    size = (len(values) + parts - 1) // parts
    for i in range(parts):
        path = os.path.join(folder, f"events-{i:03d}.json")
        with open(path, "w") as fh:
            fh.write("\n".join(values[i * size:(i + 1) * size]) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    with open(os.path.join(folder, "events-999.json"), "w") as fh:
        fh.write("{not json\n")
    os.utime(os.path.join(folder, "events-999.json"), (1_700_000_100, 1_700_000_100))
    return len(values)


def _norm(row):
    return row.asDict(recursive=True)


def test_processor_equals_batch_and_replay_is_idempotent(spark, scratch):
    src, state, ckpt = (os.path.join(scratch, d) for d in ("src", "state", "ckpt"))
    n = _write_json_files(spark, src)
    q = processor.start_processor(wire.stream_json_lines(spark, src, max_files_per_trigger=1),
                                  state, ckpt, available_now=True)
    q.awaitTermination()
    streamed = processor.snapshot_dashboard(spark, state).first()
    batch_events = wire.parse_lenient(spark.read.text(src)).withColumn(
        "seq", F.col("event_id").cast("long"))
    expected = dashboard(batch_events).first()
    assert streamed["event_counts"]["total"] == n
    assert _norm(streamed) == _norm(expected)
    rejects = spark.read.parquet(os.path.join(state, "rejects")).count()
    assert rejects == 1

    # closed-session history from the snapshots = batch sessions minus the open one
    closed = {tuple(r) for r in spark.read.parquet(os.path.join(state, "sessions"))
              .select("session_start", "session_end", "active_users", "events").collect()}
    all_sessions = active_users.global_sessions(batch_events).orderBy("session_start").collect()
    assert closed == {tuple(r) for r in all_sessions[:-1]}

    # replay the last batch id: the snapshot is rewritten, not added to
    last = processor.latest_version(spark, state)
    raw = spark.read.text(os.path.join(src, "events-999.json"))
    processor.process_json_batch(raw, last, state)
    again = processor.snapshot_dashboard(spark, state).first()
    assert _norm(again) == _norm(streamed)


def test_window_streams_equal_batch_on_closed_windows(spark, scratch):
    src = os.path.join(scratch, "src")
    _write_json_files(spark, src)
    events = wire.parse_lenient(wire.stream_json_lines(spark, src, max_files_per_trigger=1))
    batch_events = wire.parse_lenient(spark.read.text(src)).withColumn(
        "seq", F.col("event_id").cast("long"))
    out = {}
    for name, df in {
        "rev": windows.revenue_window_stream(events, "1 hour"),
        "slide": windows.sliding_users_stream(events),
        "sess": windows.session_stream(events),
    }.items():
        path = os.path.join(scratch, name)
        q = windows.start_append(df, path, os.path.join(scratch, name + "_ckpt"))
        q.awaitTermination()
        out[name] = spark.read.parquet(path)

    def as_set(df, cols):
        return {tuple(r) for r in df.select(*cols).collect()}

    exp_rev = revenue.revenue_by_window(purchases(batch_events), "1 hour").withColumn(
        "window_start", F.col("window_start").cast("timestamp"))
    got_rev = as_set(out["rev"], ["window_start", "revenue", "purchases"])
    assert got_rev and got_rev <= as_set(exp_rev, ["window_start", "revenue", "purchases"])

    exp_slide = active_users.active_users_sliding(batch_events).withColumn(
        "window_start", F.col("window_start").cast("timestamp"))
    got_slide = as_set(out["slide"], ["window_start", "active_users"])
    assert got_slide and got_slide <= as_set(exp_slide, ["window_start", "active_users"])

    exp_sess = active_users.global_sessions(batch_events).withColumn(
        "session_start", F.col("session_start").cast("timestamp"))
    got_sess = as_set(out["sess"], ["session_start", "active_users", "events"])
    assert got_sess and got_sess <= as_set(exp_sess, ["session_start", "active_users", "events"])
    # only the windows still open at the end of input are missing
    assert len(got_sess) >= exp_sess.count() - 1


def test_archive_partitions_by_event_date(spark, scratch):
    src = os.path.join(scratch, "src")
    n = _write_json_files(spark, src)
    events = wire.parse_lenient(wire.stream_json_lines(spark, src))
    path = os.path.join(scratch, "archive")
    windows.archive_stream(events, path, os.path.join(scratch, "archive_ckpt")).awaitTermination()
    archived = spark.read.parquet(path)
    assert archived.count() == n
    assert "event_date" in archived.columns
    from shopstream.sources.tables import read_canonical
    back = read_canonical(spark, path)
    assert back.count() == n and back.where(F.col("ts").isNull()).count() == 0


def test_stream_dedup_counts_a_redelivered_event_once(spark, scratch):
    src, state, ckpt = (os.path.join(scratch, d) for d in ("src", "state", "ckpt"))
    os.makedirs(src)
    line = '{"event_id": "e1", "event_type": "purchase_completed", "user_id": "u1", ' \
           '"product_name": "Lamp", "price": 10, "timestamp": "2024-01-01T12:00:00"}'
    for i in range(2):                                   # the same event delivered twice
        path = os.path.join(src, f"part-{i}.json")
        with open(path, "w") as fh:
            fh.write(line + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    raw = wire.stream_json_lines(spark, src, max_files_per_trigger=1)
    processor.start_processor(raw, state, ckpt, available_now=True, dedup=True).awaitTermination()
    row = processor.snapshot_dashboard(spark, state).first()
    assert row["event_counts"]["total"] == 1
    assert row["revenue"]["total_revenue"] == 10.0


def test_native_running_aggregates_equal_batch(spark, scratch):
    from shopstream.operators import counts, products
    from shopstream.streaming import running
    src = os.path.join(scratch, "src")
    _write_json_files(spark, src)
    events = wire.parse_lenient(wire.stream_json_lines(spark, src, max_files_per_trigger=1))
    batch_events = wire.parse_lenient(spark.read.text(src))
    for name, df, mode in (("types", running.type_counts_stream(events), "update"),
                           ("kpi", running.kpi_stream(events), "complete"),
                           ("top", running.top_products_stream(events), "complete")):
        running.start_running(df, f"run_{name}", os.path.join(scratch, f"ck_{name}"), mode).awaitTermination()
    got_types = {r["event_type"]: r["event_count"] for r in
                 spark.sql("SELECT event_type, max(event_count) AS event_count FROM run_types "
                           "GROUP BY event_type").collect()}
    exp_types = {r["event_type"]: r["event_count"] for r in counts.events_by_type(batch_events).collect()}
    assert got_types == exp_types
    kpi = spark.table("run_kpi").collect()[-1]
    exp = counts.kpi_aggregates(batch_events).first()
    assert kpi["total"] == exp["total"] and kpi["total_revenue"] == exp["total_revenue"]
    top = [tuple(r) for r in spark.table("run_top").collect()[-10:]]
    exp_top = [tuple(r) for r in products.top_products(purchases(batch_events)).collect()]
    assert sorted(top) == sorted(exp_top)


def test_report_export_writes_one_json_row(spark, scratch):
    from shopstream.plans.dashboard import dashboard
    from shopstream.sources.sinks import export_report
    path = os.path.join(scratch, "report")
    export_report(dashboard(shop_events(spark, SF_SMALL)), path)
    back = spark.read.json(path)
    assert back.count() == 1 and "recent_events" in back.columns


def test_processor_sessions_spanning_batches(spark, scratch):
    import datetime as dt
    state = os.path.join(scratch, "state")
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)

    def batch(*rows):
        return spark.createDataFrame(
            [(f"e{i}", "product_viewed", u, None, None, 0.0, 1, t0 + dt.timedelta(seconds=s), None)
             for i, (u, s) in rows],
            "event_id string, event_type string, user_id string, product_id string, product_name string, "
            "price double, quantity int, ts timestamp_ntz, metadata map<string,string>")

    processor.merge_batch(batch((1, ("a", 0))), 0, state)                  # opens S1
    processor.merge_batch(batch((2, ("b", 100))), 1, state)                # continues S1
    processor.merge_batch(batch((3, ("c", 200)), (4, ("a", 1000))), 2, state)  # S1 ends, S2 opens
    processor.merge_batch(batch((5, ("d", 1500))), 3, state)               # S2 ends, S3 opens
    closed = sorted(tuple(r) for r in spark.read.parquet(os.path.join(state, "sessions"))
                    .select("session_start", "active_users", "events").collect())
    assert closed == [(t0, 3, 3), (t0 + dt.timedelta(seconds=1000), 1, 1)]
    row = processor.snapshot_dashboard(spark, state).first()
    assert row["active_users"]["active_users"] == 1


def test_restart_from_copied_checkpoint_replays_without_double_count(spark, scratch):
    import shutil
    src, state, ckpt = (os.path.join(scratch, d) for d in ("src", "state", "ckpt"))
    n = _write_json_files(spark, src)
    raw = wire.stream_json_lines(spark, src, max_files_per_trigger=1)
    processor.start_processor(raw, state, ckpt, available_now=True).awaitTermination()
    before = processor.snapshot_dashboard(spark, state).first()
    last = processor.latest_version(spark, state)

    # a copy of the checkpoint as if the process died before committing the last batch
    crashed = os.path.join(scratch, "ckpt_copy")
    shutil.copytree(ckpt, crashed, ignore=lambda d, names: [x for x in names
                                                          if os.path.basename(d) == "commits"
                                                          and x in (str(last), f".{last}.crc")])
    raw = wire.stream_json_lines(spark, src, max_files_per_trigger=1)
    processor.start_processor(raw, state, crashed, available_now=True).awaitTermination()
    after = processor.snapshot_dashboard(spark, state).first()
    assert processor.latest_version(spark, state) == last      # the same batch id was re-run
    assert after["event_counts"]["total"] == n
    assert _norm(after) == _norm(before)
