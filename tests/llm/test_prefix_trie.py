"""The trie of conversation prefixes against a plain trie."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from shopstream.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Every node's row, from the rebuilt conversations themselves."""
    original = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            original.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    original = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in original.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(original.get(base, [])[:h] + own[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    for path, cs in members.items():
        own = (len(cs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += own
    out = []
    for path, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if rebuilt[c] == path)
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(children.get(path, [])),
                    leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **options):
    got = prefix_trie.prefix_trie(df, **options)
    return sorted((tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                                 "saved_tokens", "ends_sha256").collect()), key=repr)


def conversations(seed, n, longest, choices=2, shared=0.7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c = rng.choice([i, i, 7 * i, -i])
        for turn in range(rng.randrange(1, longest)):
            text = f"word {rng.randrange(choices)} of turn" if rng.random() < shared else f"own {i} {turn}"
            rows.append((c, turn, ("user", "assistant")[turn % 2], text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,longest,block", [(1, 150, 9, 4), (2, 60, 30, 4), (3, 80, 12, 1), (4, 80, 12, 3), (5, 40, 40, 16)])
def test_equals_plain_trie(spark, seed, n, longest, block):
    rows = conversations(seed, n, longest)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4), block=block) == plain(rows)


def test_common_conversation_and_long_chains(spark):
    """Many equal conversations, one that lies over several ranges, and deep paths that part late."""
    rows = [(c, t, "user", f"hello {t}") for c in range(1000, 1300) for t in range(5)]
    rows += [(2000, t, "user", f"turn {t}") for t in range(700)]
    rows += [(2001 + k, t, "user", f"turn {t}" if t < 130 + k else f"other {k}") for k in range(6) for t in range(150)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_awkward_rows(spark):
    rows = [(1, None, "user", "null turn first"), (1, 0, None, "no role"), (1, 1, "user", None), (1, 1, "user", ""), (1, None, None, None)]
    rows += [(None, 0, "user", "no conversation"), (None, None, None, None)]
    rows += [(20, 0, "u", "a"), (20, 0, "u", "a"), (20, 0, "u", "b"), (20, 0, "t", "b"), (21, 0, "u", "a"), (22, 0, "u", "x" * 100_000)]
    rows += [(c, 0, "u", " \t\n") for c in range(40, 60)]                    # turns without words; some end turnless
    rows += [(c, t, "u", f"{t}") for c in (101, 102, 103, 104) for t in range(3)]  # no conversation 100: turns go missing
    rows += [(-5, 0, "u", "negative"), (-21, 0, "u", "negative"), (0, 0, "u", "zero")]
    df = (spark.createDataFrame(rows, SCHEMA).repartition(3)
          .withColumns({c: F.lit("x") for c in ("c", "key", "up", "depth", "words", "n_convs", "_part")}))
    assert found(df) == plain(rows)


def test_turnless_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == [] and found(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)) == []
    lost = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:30]
    rows = [(c, 0, "u", "goes") for c in lost]                                # all turns go, none come
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert len(plain(rows)) == 1


def test_running_sums_over_range_borders(spark):
    rows = [("hot", i, i % 7) for i in range(3000)] + [(f"k{i % 40}", i, 1) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, i long, x long").repartition(3)
        got = {(r["k"], r["i"]): r["s"] for r in prefix_trie.running(df, "k", [F.col("i")], {"s": F.col("x")}).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    total, want = {}, {}
    for k, i, x in sorted(rows):
        total[k] = total.get(k, 0) + x
        want[k, i] = total[k]
    assert got == want


def test_packed_ids_cross_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PACKED_IDS", 7)
    ends = spark.createDataFrame([(bytes([i % 3]), i * 3) for i in range(200)], "key binary, c long").repartition(6)
    got = {bytes(r["key"]): r["ends_sha256"] for r in prefix_trie.ends_digests(ends).collect()}
    assert got == {bytes([k]): hashlib.sha256(",".join(str(i * 3) for i in range(200) if i % 3 == k).encode()).hexdigest()
                   for k in range(3)}
