"""Host rules and mixing: measures and budgets against plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from cases import DOCUMENTS, documents, frame

from shopstream.llm import common, host_rules, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_plain_python(spark):
    rows = documents() + [(2000, "a b c a b c a b c\nx\nx\n \nx #*$%&|<> d e f d e f", "en", "z", 0), (2001, "𝄞 é\n" * 70, "en", "z", 0)]
    got = host_rules.host_level_rules(frame(spark, rows, extra=True)).collect()
    want = sorted(((r[0], *measures(r[1])) for r in rows), key=repr)
    assert sorted(((r["doc_id"], *[r[c] for c in host_rules.MEASURES]) for r in got), key=repr) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not r["host_rejected"])


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good if i % 10 else "short", "en", f"h{i % 6}", 0) for i in range(600)]
    rows += [(1000 + i, good if i % 25 == 0 else "short", "en", "bad", 0) for i in range(200)]
    rows += [(2000, "short", "en", "tiny", 0), (2001, good, "en", "tiny", 0), (2002, "short", "en", "single", 0)]
    got = {(r["source"], r["host_rejected"]) for r in host_rules.host_level_rules(frame(spark, rows)).collect()}
    assert ("bad", True) in got and ("tiny", False) in got and all(not x for h, x in got if h != "bad" and h != "single")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert host_rules.host_level_rules(empty).collect() == []
    assert mixing.mix(empty).collect() == []


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            break
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        more = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not more:
            break
        full |= more
    return {s: 2.0 * sizes[s] if s in full else min(2.0 * sizes[s], weight[s] * level) for s in names}


@pytest.mark.parametrize("seed,broadcast", [(1, common.BROADCAST_ROWS), (4, -1)])
def test_mix_meets_the_targets(spark, seed, broadcast, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_DOCS", 4)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)          # -1: joins are salted
    rows = documents(seed)
    df = frame(spark, rows, extra=True)
    got = mixing.mix(df).collect()
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        sizes[r[3]] += n
        largest[r[3]] = max(largest[r[3]], n)
    want = targets(dict(sizes))
    for r in got:
        n = len(WORD.findall(r["text"] or ""))
        assert r["size"] == n and r["source_size"] == sizes[r["source"]] and r["taken"] in (0, n, 2 * n)
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s]
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: repr((r["doc_id"], r["size"], r["taken"]))            # noqa: E731
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_of_blank_texts_takes_nothing(spark):
    got = mixing.mix(frame(spark, [(1, "", "en", "a", 0), (2, None, "en", "b", 0)])).collect()
    assert {(r["size"], r["taken"], r["target"]) for r in got} == {(0, 0, 0.0)}


def test_ordinals_are_ranks(spark):
    df = spark.createDataFrame([(s,) for s in ["b", "a", None, "Z", "é", "a", "aa"]], "source string")
    got = {r["source"]: r["n"] for r in mixing.ordinals(df, "source", "n").collect()}
    assert got == {"Z": 0, "a": 1, "aa": 2, "b": 3, "é": 4, None: 5}


@pytest.mark.parametrize("doc_id", [7, None])
def test_rows_of_one_id_are_cut_at_the_target(spark, doc_id):
    rows = [(doc_id, f"three words {i}", "en", "a", 0) for i in range(40)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == 40 and got[0]["target"] == 180 and abs(sum(r["taken"] for r in got) - 180) <= 3
