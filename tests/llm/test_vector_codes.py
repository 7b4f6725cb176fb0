"""Product codes against a plain Lloyd iteration over all distances."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from shopstream.llm import dual_tree, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """vec_id, code, error, label_error and digest of each kept row, in Python integers."""
    kept = [(i, v, lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    most = vector_codes.limit(width)

    def ints(v):
        whole = [max(-most, min(most, math.floor(float(np.float32(x)) * scale))) for x in v]
        return whole + [0] * (width * parts - len(whole))

    points = [(i, ints(v), lab) for i, v, lab in kept]
    start = sorted(points, key=lambda p: (p[0] is None, p[0] or 0, p[1]))[:entries]

    def cut(v, k):
        return v[k * width:(k + 1) * width]

    books = [[cut(v, k) for _, v, _ in start] for k in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, z)), e) for e, z in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            members = {}
            for _, v, _ in points:
                members.setdefault(nearest(cut(v, k), books[k])[1], []).append(cut(v, k))
            for e, xs in members.items():
                books[k][e] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(c) for b in books for z in b for c in z).encode()).hexdigest()
    coded, by_label = [], {}
    for i, v, lab in points:
        best = [nearest(cut(v, k), books[k]) for k in range(parts)]
        error = sum(d for d, _ in best)
        by_label[lab] = by_label.get(lab, 0) + error
        coded.append((i, lab, "".join(f"{e:02x}" for _, e in best), error))
    return sorted(((i, code, err, by_label[lab], digest) for i, lab, code, err in coded), key=repr)


def found(df, **options):
    got = vector_codes.vector_codes(df, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def vectors(seed, n, dims=16, step=0.002):
    """Coarse values, so that many distances tie."""
    rng = random.Random(seed)
    return [(i, [rng.randrange(-6, 7) * step for _ in range(dims)], rng.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("n,dims,entries", [(400, 16, 256), (700, 8, 20), (90, 16, 256), (1, 4, 256), (300, 4, 3)])
def test_equals_plain_rounds(spark, n, dims, entries):
    rows = vectors(n, n, dims)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(df, entries=entries, chunk=150) == plain(rows, entries=entries)


def test_awkward_rows(spark):
    rows = vectors(7, 60)
    rows += [(100, None, 1), (101, [0.1, None] * 8, 1), (102, [float("nan")] * 16, 1), (103, [float("inf")] + [0.0] * 15, 2)]
    rows += [(None, [0.5] * 16, None), (None, [0.25] * 16, 3), (5, [0.125] * 16, 3), (5, [0.125] * 16, 3)]     # repeated, without id
    rows += [(200, [0.1] * 3, 4), (201, [], 4), (202, [3e38] * 16, 5), (203, [-3e38, 3e38] * 8, 5)]              # short, empty, huge
    rows += [(300 + i, [0.01] * 16, 6) for i in range(500)]                                                      # one common vector
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "'x' AS code", "'y' AS id", "1 AS n", "2 AS error")
    assert found(df, chunk=64) == plain(rows)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == []
    assert found(spark.createDataFrame([(1, None, 1)], SCHEMA)) == []
    assert vector_codes.vector_codes(empty).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_nodes_are_assigned_whole():
    """Groups that lie apart never come down to single points, and cached sums equal the points' sums."""
    rng = np.random.default_rng(3)
    middles = rng.integers(-10_000, 10_000, (16, 8))
    points = np.repeat(middles, 256, axis=0) + rng.integers(-3, 4, (16 * 256, 8))
    tree = dual_tree.build(points)
    calls, sums, count = [], np.zeros((16, 8), np.int64), np.zeros(16, np.int64)

    def whole(entry, node_sums, n):
        calls.extend(n.tolist())
        np.add.at(sums, entry, node_sums)
        np.add.at(count, entry, n)

    placed = points[tree.order]
    got = dual_tree.assign(placed, tree, middles, whole)
    want = ((placed[:, None] - middles[None]) ** 2).sum(2).argmin(1)
    assert (got == want).all() and (count == 256).all()
    assert (sums == [placed[want == e].sum(0) for e in range(16)]).all()
    assert len(calls) < len(points) / 20


@pytest.mark.parametrize("n,k,width,spread", [(4096, 256, 16, 150), (500, 7, 3, 2), (65, 64, 2, 1), (1, 1, 1, 5), (257, 256, 4, 0), (3000, 200, 16, 1 << 28)])
def test_assignment_is_exact(n, k, width, spread):
    rng = np.random.default_rng(n)
    points = rng.integers(-spread, spread + 1, (n, width))
    entries = points[rng.permutation(n)[:k]]
    tree = dual_tree.build(points)
    placed = points[tree.order]
    assert (dual_tree.assign(placed, tree, entries) == ((placed[:, None] - entries[None]) ** 2).sum(2).argmin(1)).all()
