"""Streams with keyed state against direct computations: order, late rows, replays, state size."""

from __future__ import annotations

import datetime as dt
import glob
import os
import random
import types

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shopstream.operators import active_users, revenue
from shopstream.operators.events import purchases
from shopstream.plans import streams
from shopstream.sources import json_events as wire
from shopstream.streaming import carts, corrections, dedup, idle_state, processor
from shopstream.streaming.replay import read_arrivals, replay, state_conf, write_arrivals
from shopstream.streaming.windows import start_append

T0 = dt.datetime(2024, 3, 1, 12, 0, 0)
EVENT = ("seq long, event_id string, event_type string, user_id string, product_id string, product_name string, "
         "price double, quantity long, ts timestamp_ntz, metadata map<string,string>")


def event(seq, second, kind="product_viewed", user="u", price=1.0, event_id=None):
    at = None if second is None else T0 + dt.timedelta(seconds=second)
    return (seq, f"e{seq}" if event_id is None else event_id, kind, user, "p", "Lamp", price, 1, at, None)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --------------------------------------------------------------------------- idle sessions
def sessions_by_hand(times_users, gap=300):
    out = []
    for second, user in sorted(times_users, key=lambda x: x[0]):
        if not out or second - out[-1][1] >= gap:
            out.append([second, second, set(), 0])
        out[-1][1] = second
        out[-1][2].add(user or "unknown")
        out[-1][3] += 1
    return sorted(((T0 + dt.timedelta(seconds=a), T0 + dt.timedelta(seconds=b + gap), len(u), n) for a, b, u, n in out), key=repr)


@pytest.mark.parametrize("seed,shards", [(1, 1), (2, 3), (3, 16)])
def test_idle_sessions_equal_a_direct_sweep(spark, scratch, seed, shards):
    """Gaps around the limit, one very busy user, rows a little out of order; the last session is still open."""
    rng = random.Random(seed)
    second, seen = 0, []
    for _ in range(260):
        second += rng.choice([0, 1, 20, 60, 60, 299, 300, 301, 900])
        seen.append((second, rng.choice(["busy", "busy", "a", "b", "c", None])))
    rows = [event(i, s, user=u) for i, (s, u) in enumerate(seen)]
    events = spark.createDataFrame(rows, EVENT)
    jitter = F.col("seq") + F.pmod(F.xxhash64("seq"), F.lit(3))        # neighbours swap, also over files
    out, checkpoint = os.path.join(scratch, "out"), os.path.join(scratch, "ck")
    with state_conf(spark):
        stream = replay(events, os.path.join(scratch, "src"), 5, jitter)
        idle_state.start_pieces(idle_state.session_pieces(stream, watermark="30 minutes", shards=shards), out, checkpoint).awaitTermination()
        pieces = spark.read.schema(idle_state.PIECES).parquet(out)
        still_open = idle_state.open_pieces(spark, checkpoint)
        got = idle_state.sessions_of_pieces(pieces.unionByName(still_open), events)
        assert still_open.count() > 0
        assert rows_of(got) == sessions_by_hand(seen) == rows_of(active_users.global_sessions(events))
        if shards > 1:                                                 # one user's rows lie on several shards
            assert pieces.unionByName(still_open).where("user_id = 'busy'").select("shard").distinct().count() > 1


def test_closed_pieces_leave_the_state(spark, scratch):
    rows = [event(i, 1000 * i, user=f"u{i}") for i in range(40)]        # every event a session of its own
    out, checkpoint = os.path.join(scratch, "out"), os.path.join(scratch, "ck")
    with state_conf(spark):
        stream = replay(spark.createDataFrame(rows, EVENT), os.path.join(scratch, "src"), 4)
        idle_state.start_pieces(idle_state.session_pieces(stream, shards=2), out, checkpoint).awaitTermination()
        assert idle_state.open_pieces(spark, checkpoint).count() <= 2
    assert spark.read.schema(idle_state.PIECES).parquet(out).count() >= 38


class Held:
    """State of one key in plain Python; ``calls`` counts what goes to the state."""

    def __init__(self):
        self.value, self.packs, self.timers, self.calls = None, [], set(), 0

    def getValueState(self, name, schema):
        def update(value):
            self.value, self.calls = value, self.calls + 1

        return types.SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=update, clear=lambda: update(None))

    def getListState(self, name, schema):
        def append(pack):
            self.packs, self.calls = self.packs + [pack], self.calls + 1

        def get():
            self.calls += 1
            return iter(self.packs)

        return types.SimpleNamespace(get=get, appendValue=append, clear=lambda: setattr(self, "packs", []))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


@pytest.mark.parametrize("seed,steps", [(1, [0, 1, 2]), (2, [0, 5, 60, 299, 300, 301]), (3, [0, 1, 1, 1, 1, 1, 1, 1, 900])])
def test_a_batch_makes_few_state_calls(monkeypatch, seed, steps):
    """30 batches of 400 rows, rows out of order over batches: pieces as in a plain sweep, calls by batch and not by user."""
    monkeypatch.setattr(idle_state, "SLACK", 100)
    rng = random.Random(seed)
    second, seen = 0, []
    for _ in range(12_000):
        second += rng.choice(steps)
        seen.append((second, f"u{rng.randrange(600)}"))
    order = sorted(range(len(seen)), key=lambda i: i + rng.choice([0, 0, 0, 500]))
    us = [round((T0 + dt.timedelta(seconds=s) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) for s, _ in seen]
    state, out = Held(), []
    processor_ = idle_state._processor(300)
    processor_.init(state)
    for at in range(0, len(order), 400):
        part = pd.DataFrame({"us": [us[i] for i in order[at:at + 400]], "user_id": [seen[i][1] for i in order[at:at + 400]]})
        state.calls = 0
        out += list(processor_.handleInputRows((7,), iter([part[:150], part[150:]]), None))
        assert state.calls <= 4 and len(state.timers) == 1
        users = [u for pack, _ in state.packs for u in pack]
        assert len(users) <= 2 * len(set(users)) + 100
    ended = types.SimpleNamespace(getExpiryTimeInMs=lambda: max(state.timers))
    out += list(processor_.handleExpiredTimer((7,), None, ended))
    assert state.value is None and not state.packs and len(out) <= 61     # at most two frames a batch, however many pieces
    pieces = pd.concat(out)
    assert pieces.columns.tolist() == ["shard", "user_id", "lo", "hi", "n"] and set(pieces["shard"]) == {7}
    sessions = []
    for lo, hi, user, n in sorted(pieces[["lo", "hi", "user_id", "n"]].itertuples(index=False)):
        if not sessions or lo - sessions[-1][1] >= 300_000_000:
            sessions.append([lo, hi, set(), 0])
        sessions[-1][1] = max(sessions[-1][1], hi)
        sessions[-1][2].add(user)
        sessions[-1][3] += n
    at = {u: T0 + dt.timedelta(seconds=s) for u, (s, _) in zip(us, seen)}
    got = [(at[lo], at[hi] + dt.timedelta(seconds=300), len(users), n) for lo, hi, users, n in sessions]
    assert sorted(got, key=repr) == sessions_by_hand(seen)


def test_sessions_of_ids_that_do_not_follow_time(spark, scratch):
    """Three copies of a day's events with ids shifted: each copy's first event is a day before the last one's end."""
    rng = random.Random(8)
    times = [T0 + dt.timedelta(seconds=rng.randrange(86_400)) for _ in range(300)]
    rows = [(copy * 1000 + i, t, copy * 50 + i % 50, "view", 1.0, '{"k": 1}') for copy in range(3) for i, t in enumerate(sorted(times))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        os.path.join(scratch, "events.parquet"))
    want = sessions_by_hand([((t - T0).total_seconds(), str(user)) for _, t, user, *_ in rows])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert rows_of(streams.stream_active_sessions(spark, scratch)) == want
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


# --------------------------------------------------------------------------- late windows
def test_late_rows_correct_published_windows(spark, scratch):
    def batch(*rows):
        return spark.createDataFrame(list(rows), EVENT)

    def paid(seq, second, price):
        return event(seq, second, "purchase_completed", price=price)

    state = os.path.join(scratch, "state")
    batches = [
        batch(paid(1, 10, 1.0), paid(2, 70, 2.0), paid(3, 200, 4.0)),
        batch(paid(4, 30, 8.0), paid(5, 400, 16.0), event(6, 35)),       # second 30 is late: minute 0 is out
        batch(paid(7, 31, 32.0), paid(8, 130, 64.0)),                    # late again, and late into a minute never seen
        batch(event(9, 5000), paid(10, None, 3.0)),
        batch(),
    ]
    for i, b in enumerate(batches):
        corrections.fold_batch(b, i, state)
    log = rows_of(corrections.changes(spark, state).where(F.col("window_start") == F.lit(T0))
                  .select("v", "op", F.col("acc").cast("double"), "purchases"))
    assert log == [(0, "insert", 1.0, 1), (1, "retract", 1.0, 1), (1, "upsert", 9.0, 2), (2, "retract", 9.0, 2), (2, "upsert", 41.0, 3)]
    every = batches[0]
    for b in batches[1:]:
        every = every.unionByName(b)
    expected = rows_of(revenue.revenue_by_window(purchases(every.where("ts IS NOT NULL")), "1 minute"))
    assert rows_of(corrections.window_values(spark, state)) == expected
    assert rows_of(corrections.window_values(spark, state, with_open=False)) == expected   # the line has passed them all

    corrections.fold_batch(batches[4], 4, state)                          # the last version once more
    assert rows_of(corrections.window_values(spark, state)) == expected
    with pytest.raises(ValueError):
        corrections.fold_batch(batches[0], 0, state)                      # another checkpoint's state
    with pytest.raises(ValueError):
        corrections.fold_batch(batches[0], 9, state)


def test_shuffled_replays_give_the_same_windows(spark, scratch):
    rng = random.Random(5)
    rows = [event(i, rng.randrange(4000), rng.choice(["purchase_completed", "cart_added"]), price=rng.randrange(1, 500) / 100)
            for i in range(300)]
    events = spark.createDataFrame(rows, EVENT)
    expected = rows_of(revenue.revenue_by_window(purchases(events), "1 minute"))
    for k, order in enumerate((F.col("seq"), F.col("ts"), F.desc("ts"))):
        state = os.path.join(scratch, f"state{k}")
        arrival = F.unix_micros(F.col("ts").cast("timestamp")) * (-1 if k == 2 else 1) if k else order
        stream = replay(events, os.path.join(scratch, f"src{k}"), 3, arrival)
        corrections.start_corrections(stream, state, os.path.join(scratch, f"ck{k}"), available_now=True).awaitTermination()
        assert rows_of(corrections.window_values(spark, state)) == expected
        ops = {r["op"] for r in corrections.changes(spark, state).select("op").distinct().collect()}
        assert ("upsert" in ops) == (k != 1)                              # in order, nothing is late


# --------------------------------------------------------------------------- carts
def test_unpurchased_carts_and_bounded_state(spark, scratch):
    hour = 3600
    rows = [event(1, 0, "cart_added", "bought"), event(2, hour, "purchase_completed", "bought"),
            event(3, 10, "cart_added", "too late"), event(4, 10 + 24 * hour, "purchase_completed", "too late"),
            event(5, 20, "purchase_completed", "before"), event(6, 30, "cart_added", "before"),
            event(7, 40, "cart_added", "same second"), event(8, 40, "purchase_completed", "same second"),
            event(9, 50, "cart_added", None), event(10, 60, "purchase_completed", None)]
    rows += [event(100 + i, 100 + i, "cart_added", "busy") for i in range(50)] + [event(200, 120, "purchase_completed", "busy")]
    rows += [event(300 + i, 40 * hour + i * hour, "cart_added", f"later{i}") for i in range(100)]
    events = spark.createDataFrame(rows, EVENT)
    out, checkpoint = os.path.join(scratch, "out"), os.path.join(scratch, "ck")
    with state_conf(spark):
        both = events.unionByName(carts.heartbeat(events, "2 days"))
        stream = replay(both, os.path.join(scratch, "src"), 6, F.unix_micros(F.col("ts").cast("timestamp")))
        query = start_append(carts.unpurchased_stream(stream), out, checkpoint)
        query.awaitTermination()
    got = {r["event_id"] for r in carts.unpurchased_carts(spark.read.parquet(out)).collect()}
    late = {f"e{100 + i}" for i in range(50) if 100 + i > 120}
    assert got == {"e3", "e6", "e9"} | late | {f"e{300 + i}" for i in range(100)}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert kept[-1] <= 2 * (1 + carts.SALTS)                              # heartbeats alone are left


# --------------------------------------------------------------------------- redeliveries
def test_id_index_grows_by_the_batch(spark, scratch):
    """1,600 ids over eight batches, half of every batch delivered again later; what a batch writes stays level."""
    rows = [event(i, i, event_id=f"id{i}") for i in range(1600)] + [event(2000 + i, i, event_id=f"id{i}") for i in range(0, 1600, 2)]
    rows += [event(5000 + i, i)[:1] + (None,) + event(5000 + i, i)[2:] for i in range(20)]
    events = spark.createDataFrame(rows, EVENT).drop("metadata")
    again = F.when(F.col("seq").between(2000, 4999), (F.col("seq") - 2000) + F.pmod(F.xxhash64("seq"), F.lit(1000)))
    arrival = F.coalesce(again, F.pmod(F.col("seq"), F.lit(5000)))
    out, checkpoint = os.path.join(scratch, "out"), os.path.join(scratch, "ck")
    with state_conf(spark):
        stream = replay(events, os.path.join(scratch, "src"), 8, arrival)
        query = start_append(dedup.unique_events(stream), out, checkpoint)
        query.awaitTermination()
    got = spark.read.parquet(out)
    assert got.where("event_id IS NULL").count() == 20
    assert got.where("event_id IS NOT NULL").count() == got.select("event_id").distinct().count() - 1 == 1600
    state = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
    assert len(state) == 8 and state[-1]["numRowsTotal"] == 1600
    written = {}
    for path in glob.glob(os.path.join(checkpoint, "state", "**", "*.changelog"), recursive=True):
        version = int(os.path.basename(path).split(".")[0].split("_")[0])
        written[version] = written.get(version, 0) + os.path.getsize(path)
    sizes = [written[v] for v in sorted(written)]
    assert len(sizes) >= 8 and max(sizes[4:8]) <= 2 * max(sizes[:4])      # follows the batch, not the index


def test_processor_over_unique_messages(spark, scratch):
    src, state = os.path.join(scratch, "src"), os.path.join(scratch, "state")
    line = '{"event_id": "%s", "event_type": "purchase_completed", "user_id": "u", "product_name": "Lamp", "price": 10, "timestamp": "2024-01-01T12:00:00"}'
    lines = [line % "a", line % "b", line % "a", "{broken", line.replace('"event_id": "%s", ', ""), line.replace('"event_id": "%s", ', "")]
    lines += [line % "b", line % "c"]
    write_arrivals(spark.createDataFrame(list(enumerate(lines)), "i int, value string"), src, 4, F.col("i"))
    with state_conf(spark):
        raw = read_arrivals(spark, src, "i int, value string").select("value")
        processor.start_processor(dedup.unique_messages(raw), state, os.path.join(scratch, "ck"), available_now=True).awaitTermination()
    row = processor.snapshot_dashboard(spark, state).first()
    assert row["event_counts"]["total"] == 5 and row["revenue"]["total_revenue"] == 50.0
    assert spark.read.parquet(os.path.join(state, "rejects")).count() == 1


def test_dedupe_stream_within_the_watermark(spark, scratch):
    rows = [event(1, 0, event_id="x"), event(2, 5, event_id="x"), event(3, 10, event_id="y"), event(4, 7200, event_id="z"),
            event(5, 10000, event_id="w"), event(6, 14400, event_id="x")]  # long after: its id is forgotten
    stream = replay(spark.createDataFrame(rows, EVENT).drop("metadata"), os.path.join(scratch, "src"), 6)
    out = os.path.join(scratch, "out")
    start_append(processor.dedupe_stream(stream, "10 minutes"), out, os.path.join(scratch, "ck")).awaitTermination()
    got = sorted(r["event_id"] for r in spark.read.parquet(out).collect())
    assert got == ["w", "x", "x", "y", "z"]


def test_reject_sink_keeps_what_is_no_object(spark, scratch):
    src = os.path.join(scratch, "src")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as fh:
        fh.write('{"event_id": "1"}\n[1]\n"text"\n{bad\n\n{"a": NaN}\n')
    out = os.path.join(scratch, "rejects")
    processor.start_reject_sink(wire.stream_json_lines(spark, src).select("value"), out, os.path.join(scratch, "ck"), True).awaitTermination()
    got = {(r["raw_value"], r["reasons"]) for r in spark.read.parquet(out).collect()}
    assert got == {(t, "malformed_json") for t in ("[1]", '"text"', "{bad", "", '{"a": NaN}')}
