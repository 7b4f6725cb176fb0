"""Quality classifier, decontamination, registered queries and the pipeline."""

import random
import re

import numpy as np
import pytest
from cases import DOCUMENTS, documents, frame, prose
from conftest import SF_MID, SF_SMALL
from oracle_compare import compare_all

import corpus_pipeline
from shopstream.llm import catalog, decontaminate, quality
from shopstream.llm.common import table


def test_queries_with_sql_match_it(spark):
    results = compare_all(spark, SF_SMALL, sorted(catalog.oracle_sql()))
    assert [r for r in results if r["status"] != "match"] == []


def test_held_out_accuracy(spark):
    got = quality.op6_quality(spark, SF_MID).join(table(spark, SF_MID, "labels", "doc_id", "quality"), "doc_id").filter("held_out").collect()
    good = np.array([r["score"] for r in got if r["quality"] == 1])
    bad = np.array([r["score"] for r in got if r["quality"] == 0])
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert (good >= 0.3).mean() > 0.95 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


LABELS = "doc_id long, quality int, toxic int"


def test_quality_of_awkward_rows(spark):
    rows = documents()
    df = frame(spark, rows, extra=True)
    labels = spark.createDataFrame([(r[0], (r[0] or 0) % 2, 0) for r in rows if r[0] is None or r[0] < 30] + [(5, None, 0), (7777, 1, 0)], LABELS)
    got = quality.quality_scores(df, quality.train(df, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    only = quality.train(df, labels.filter("quality = 1"))
    assert len({r["score"] for r in quality.quality_scores(df, only).collect()}) == 1
    none = quality.train(df, labels.limit(0))
    assert {r["score"] for r in quality.quality_scores(df, none).collect()} == {0.5}
    assert quality.quality_scores(df.limit(0), none).collect() == []


def test_dual_descent_separates():
    rng = np.random.RandomState(0)
    rows = [np.array([0, 2 + i % 5]) if i % 2 else np.array([1, 2 + i % 5]) for i in range(60)]
    w, b = quality.dual_descent(rows, [np.ones(2)] * 60, np.where(np.arange(60) % 2, 1.0, -1.0), np.ones(60))
    assert all((w[r].sum() + b > 0) == bool(i % 2) for i, r in enumerate(rows)) and rng is not None


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub(r"[\W_]+", lambda m: "".join(c for c in m[0] if c in " \t\n\x0b\x0c\r"), (text or "").lower())) if w]


def stretches(rows, items):
    """Pairs whose best stretch on some diagonal with a seed hit is long enough, by trying all stretches."""
    found = set()
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    for doc_id, text, *_ in rows:
        d = tokens(text)
        for item_id, t in items:
            b = tokens(t)
            shifts = set()
            for m in masks:
                at = {}
                for i in range(len(b) - m[-1]):
                    at.setdefault(tuple(b[i + k] for k in m), []).append(i)
                for j in range(len(d) - m[-1]):
                    for i in at.get(tuple(d[j + k] for k in m), ()):
                        shifts.add(j - i)
            for s in shifts:
                v = [1 if d[s + i] == b[i] else -1 for i in range(max(0, -s), min(len(b), len(d) - s))]
                best = cur = 0
                for x in v:
                    cur = max(0, cur + x)
                    best = max(best, cur)
                if best >= 7 and best >= 0.4 * min(len(b), 32):
                    found.add((doc_id, item_id))
    return found


def test_every_accepted_stretch_has_a_seed():
    """All stretches of up to 64 tokens without a seed, as their last bits, length and substitutions."""
    masks = [(int(m, 2), len(m)) for m in decontaminate.MASKS]
    assert max(n for _, n in masks) <= decontaminate.MIN_SCORE
    assert all("0" in m and m[0] == m[-1] == "1" and m.count("1") >= 4 for m in decontaminate.MASKS)
    keep = (1 << max(n for _, n in masks) - 1) - 1
    states = {(1, 0)}
    for length in range(1, 65):
        assert not [x for bits, x in states if length - 2 * x >= decontaminate.MIN_SCORE and 3 * x <= length]
        grown = {(bits << 1 | match, x + 1 - match) for bits, x in states for match in (0, 1)}
        states = {(bits & keep, x) for bits, x in grown
                  if not any(length + 1 >= n and bits & m == m for m, n in masks)}


def test_adjacent_and_frequent_substitutions_are_found(spark):
    rng = random.Random(3)
    cases = [(15, (6, 7)), (15, (7, 8)), (16, (7, 8)), (32, (6, 7, 14, 15, 22, 23, 30, 31)), (11, (3, 7)), (7, ())]
    items = [(i, prose(rng, n)) for i, (n, _) in enumerate(cases)]
    rows = []
    for (i, text), (_, places) in zip(items, cases):
        words = ["other" if k in places else w for k, w in enumerate(text.split())]
        rows.append((i, prose(rng, 20) + " " + " ".join(words) + " " + prose(rng, 20), "en", "a", 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, rows), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, i) for i in range(len(cases))]


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_SEEDS, 0])
def test_passages_with_substitutions(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate((8, 10, 12, 20, 40, 60, 5, 0))] + [(20, None), (None, prose(rng, 30)), (30, "a b " * 12)]
    rows, planted = documents(), set()
    for k, (item_id, text) in enumerate(items):
        words = (text or "").split()
        if len(words) >= 10 and item_id != 30:
            for swap in range(len(words) // 10 + 1):
                changed = list(words)
                for p in rng.sample(range(len(words)), swap):
                    changed[p] = "other"
                doc_id = 5000 + 100 * k + swap
                rows.append((doc_id, prose(rng, 30) + ". " + " ".join(changed).upper() + ", " + prose(rng, 40), "en", "a", 0))
                planted.add((doc_id, item_id))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, rows, extra=True), bench).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert pairs == stretches(rows, items) and len(got) == len(pairs)
    assert planted <= pairs and {p for p in pairs if p[0] is None or p[0] < 5000} == set()
    assert decontaminate.contaminated(frame(spark, rows).limit(0), bench).collect() == []
    assert decontaminate.contaminated(frame(spark, rows), bench.limit(0)).collect() == []


def test_pipeline_stage_by_stage(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "decontamination", "mixing"]
    docs = table(spark, SF_SMALL, "documents", *corpus_pipeline.COLUMNS)
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_SMALL)
        assert kept.columns == list(corpus_pipeline.COLUMNS)
        assert kept.exceptAll(docs).count() == 0                 # rows stay as they are
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == [*corpus_pipeline.COLUMNS, "epoch", "size", "target"]
    assert 0 < out.select("doc_id").distinct().count() < before
    assert out.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2


def test_pipeline_takes_awkward_rows_and_empty_tables(spark):
    df = frame(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF_SMALL)
        assert set(corpus_pipeline.COLUMNS) <= set(out.columns)
        assert out.count() <= 2 * df.count()
        assert stage(spark, spark.createDataFrame([], DOCUMENTS), SF_SMALL).count() == 0
