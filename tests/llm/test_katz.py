"""Katz backoff against a direct evaluation, and its normalisation."""

import math
import zlib
from collections import Counter

import pytest
from cases import DOCUMENTS, documents, frame

from shopstream.llm import katz


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w] + ["</s>"]


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 if doc_id is not None else 0


class Direct:
    """The model from plain counters."""

    def __init__(self, rows, order, min_count):
        self.order, self.min_count = order, min_count
        self.c = {n: Counter() for n in range(1, order + 1)}
        self.after = Counter()
        for r in rows:
            if fold(r[0]) != katz.HELD_OUT_FOLD:
                t = ["<s>", *tokens(r[1])]
                for n in range(1, order + 1):
                    for j in range(max(1, n - 1), len(t)):
                        g = tuple(t[j - n + 1:j + 1])
                        if len(g) == n:
                            self.c[n][g] += 1
                            self.after[g[:-1]] += 1 if n > 1 else 0
        self.d = {}
        for n, counts in self.c.items():
            n_r = [sum(v == r for v in counts.values()) for r in range(1, 7)]
            self.d[n] = katz.discounts(n_r).tolist()
        self.n = sum(self.c[1].values())
        kept = sum(self.disc(v, 1) for v in self.c[1].values())
        self.unknown = (self.n - kept) / self.n if self.n and self.n - kept > 1e-9 else 1 / (self.n + 1)
        self.scale = (1 - self.unknown) / kept if kept else 0

    def disc(self, c, n):
        return c * self.d[n][c] if c <= 5 else c

    def p(self, w, h):
        h = tuple(h)
        if not h:
            c = self.c[1][(w,)]
            return self.disc(c, 1) * self.scale if c else self.unknown
        n = len(h) + 1
        held = {g[-1]: c for g, c in self.c[n].items() if g[:-1] == h and c >= self.min_count}
        if not held:
            return self.p(w, h[1:])
        mass, size = sum(self.disc(c, n) for c in held.values()), self.after[h]
        size += mass >= size - 1e-9
        if w in held:
            return self.disc(held[w], n) / size
        return (1 - mass / size) / (1 - sum(self.p(v, h[1:]) for v in held)) * self.p(w, h[1:])

    def score(self, text):
        t = ["<s>", *tokens(text)]
        return sum(math.log10(self.p(t[j], t[max(0, j - self.order + 1):j])) for j in range(1, len(t)))


@pytest.mark.parametrize("order,min_count", [(2, 2), (3, 1)])
def test_scores_equal_the_direct_model(spark, order, min_count, monkeypatch):
    rows = [r for r in documents() if r[1] is None or len(r[1]) < 20000]
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 300)
    monkeypatch.setattr(katz, "PART_KEYS", 700)
    got = katz.katz_scores(frame(spark, rows, extra=True), order, min_count)[0].collect()
    model = Direct(rows, order, min_count)
    v = len(model.c[1])
    want = []
    for r in rows:
        t = tokens(r[1])
        base = sum(math.log10((model.c[1][(w,)] + 0.5) / (model.n + 0.5 * (v + 1))) for w in t)
        want.append((r[0], fold(r[0]) == 1, len(t), sum((w,) in model.c[1] for w in t), model.n, base, model.score(r[1])))
    key = lambda r: (repr(r[0]), r[2], round(r[6], 6))          # noqa: E731
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], abs=1e-6)


def test_query_holds_every_ngram_seen(spark, scratch):
    rows = [r for r in documents() if r[1] is None or len(r[1]) < 20000]
    frame(spark, rows).write.parquet(f"{scratch}/documents.parquet")
    got = katz.op7_katz(spark, scratch).collect()
    model = Direct(rows, katz.ORDER, 1)
    assert any(c == 1 for c in model.c[2].values())
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(model.score(r[1]) for r in rows), abs=1e-6)


def test_direct_model_sums_to_one():
    rows = [r for r in documents() if r[1] is None or len(r[1]) < 20000]
    model = Direct(rows, 3, 2)
    words = [g[0] for g in model.c[1]]
    some = [(), ("<s>",), *[g for g in list(model.c[2])[::40]], *[(w,) for w in words[::60]]]
    for h in some:
        assert sum(model.p(w, h) for w in words) + model.p("never seen", h) == pytest.approx(1)


def test_empty_table_and_no_training_rows(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert katz.katz_scores(empty)[0].collect() == []
    held = next(i for i in range(100) if fold(i) == 1)
    row = katz.katz_scores(frame(spark, [(held, "a b", "en", "s", 3)]))[0].collect()
    assert [tuple(r) for r in row] == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_tables_hold_the_counts(spark):
    from shopstream.llm.packed import unpack, unpack_sorted
    rows = documents()
    _, tables = katz.katz_scores(frame(spark, rows), 2, 2)
    total = 0
    for r in tables.filter("level = 1").collect():
        body = bytes(r["body"])
        n = int.from_bytes(body[:8], "little")
        keys, counts = unpack_sorted(body[8:8 + n]), unpack(body[8 + n:], "int64")
        assert len(keys) == len(counts)
        total += int(counts.sum())
    starts = sum(fold(r[0]) != 1 for r in rows)                  # start tokens are held as histories
    assert total == sum(len(tokens(r[1])) for r in rows if fold(r[0]) != 1) + starts
