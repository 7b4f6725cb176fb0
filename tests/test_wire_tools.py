"""Key placement against the hash's published values; field profiles against a plain walk."""

from __future__ import annotations

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from shopstream.sources.placement import murmur2, partition_of, placed
from shopstream.sources.profile import field_profile

# Published results of the producer's hash, as signed 32-bit integers.
KNOWN = {
    "21": -973932308,
    "foobar": -790332482,
    "a-little-bit-long-string": -985981536,
    "a-little-bit-longer-string": -1486304829,
    "lkjh234lh9fiuh90y23oiuhsafujhadof229phr9h19h89h8": -58897971,
    "abc": 479470107,
}


def murmur2_by_hand(data: bytes) -> int:
    h, m = 0x9747B28C ^ len(data), 0x5BD1E995
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i:i + 4], "little") * m & 0xFFFFFFFF
        h = (h * m & 0xFFFFFFFF) ^ ((k ^ k >> 24) * m & 0xFFFFFFFF)
    if data[whole:]:
        h = (h ^ int.from_bytes(data[whole:], "little")) * m & 0xFFFFFFFF
    h = (h ^ h >> 13) * m & 0xFFFFFFFF
    return h ^ h >> 15


def test_murmur2_published_values(spark):
    df = spark.createDataFrame([(k,) for k in KNOWN], "k string")
    got = {r["k"]: r["h"] for r in df.select("k", murmur2(F.col("k")).alias("h")).collect()}
    assert got == {k: v % (1 << 32) for k, v in KNOWN.items()}


def test_partitions_of_odd_keys(spark):
    rng = random.Random(4)
    keys = ["", None, "é", "ß€", "日本語", "😀x", "x" * 1000, "a\0b", " "] + ["".join(rng.choice("aé€😀9") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, key string")
    got = {r["i"]: r["p"] for r in df.select("i", partition_of(F.col("key"), 7).alias("p")).collect()}
    assert got == {i: (murmur2_by_hand(k.encode()) & 0x7FFFFFFF) % 7 if k else None for i, k in enumerate(keys)}


def test_placed_rows_keep_each_keys_order(spark):
    rows = [(i, random.Random(i).choice(["u1", "u2", "hot", "hot", "hot", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "seq int, key string").repartition(5)
    got = placed(df, 4, ["seq"]).withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).collect()
    assert len(got) == 500
    where = {}
    for r in got:
        if r["key"] is not None:
            assert where.setdefault(r["key"], (r["partition"], r["task"])) == (r["partition"], r["task"])
    for key in ("u1", "u2", "hot"):
        seqs = [r["seq"] for r in sorted(got, key=lambda r: r["place"]) if r["key"] == key]
        assert seqs == sorted(seqs)


def walk(value, path, out):
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}
    out[path, kinds.get(type(value), "number")] += 1
    if isinstance(value, dict):
        for k, v in value.items():
            walk(v, f"{path}.{k}", out)
    elif isinstance(value, list):
        for v in value:
            walk(v, f"{path}[*]", out)


def test_field_profile(spark):
    docs = [{"a": 1, "b": {"c": [1, "x", None, {"d": [[]]}], "e": {}}}, {"a": "1", "z": True}, {"a": 1.5e300}, {}, [], [1, [2, [3, "deep"]]],
            "text", 7, None, True, {"é k": -1, "a": 12345678901234567890123}, {"long": "x" * 50_000}]
    texts = [json.dumps(d) for d in docs] + ["{broken", "", None, "NaN"] + [json.dumps({"hot": i}) for i in range(300)]
    want = Counter()
    for t in texts:
        if t in ("{broken", "", None, "NaN"):
            want["$", "malformed"] += 1
        else:
            walk(json.loads(t), "$", want)
    df = spark.createDataFrame([(t, "clash") for t in texts], "value string, path string").repartition(3)
    got = {(r["path"], r["kind"]): r["n"] for r in field_profile(df).collect()}
    assert got == dict(want)
    assert field_profile(df.limit(0)).collect() == []


def test_field_profile_reads_each_message_once(spark):
    """Six levels deep, and still one reading of the messages: they are counted by shape, the levels open shapes alone."""
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda text: read.add(1) or text).asNondeterministic()
    texts = [json.dumps({"id": i, "name": f"n{i}", "in": [{"a": [{"b": -i / 7}]}] * (i % 3)}) for i in range(200)]
    raw = spark.createDataFrame([(t,) for t in texts], "value string").repartition(4).select(seen("value").alias("value"))
    want = Counter()
    for t in texts:
        walk(json.loads(t), "$", want)
    assert {(r["path"], r["kind"]): r["n"] for r in field_profile(raw).collect()} == dict(want)
    assert read.value == len(texts)


def test_field_profile_of_odd_texts(spark):
    """Quotes, colons, digits and escapes in names and values; spaces; junk after a document, which the parser leaves unread."""
    docs = [{'q"1:2': 'a"b: 3', "12": "\\", "": [1, -2.5e-3, ""], "\\": "\\\"", "x\ty": "12"}, {"a:": {"b :": ": "}}, ["", 0, "\x01", ":\x01"],
            {"\x01": "\x01"}, {"long": '\\"' * 20_000}, {"k" * 3000: [[], {}, [None, True]]}, "a: 1", -0.0, [-1, 1e30]]
    texts = [json.dumps(d) for d in docs] + [json.dumps(d, ensure_ascii=False, indent=1, separators=(" , ", " :\n ")) for d in docs]
    rest = [('{"a":1} {"b', {"a": 1}), ('{"a":"\\u0031\\/"}x"', {"a": "1/"}), ('"a" : 1', "a"), ("1 2", 1), ("[1]2", [1]), ('{"b":1,"b":"x"}', {"b": "x"})]
    broken = ['{"a":"\x01"}', "{'a':1}", '{"a":01}', '{"a":1', '["a" 1]', "1x", "\x010", '{"a":+1}', "[" * 2000 + "]" * 2000, "1" * 2000]
    want = Counter({("$", "malformed"): len(broken)})
    for doc in [json.loads(t) for t in texts] + [d for _, d in rest]:
        walk(doc, "$", want)
    df = spark.createDataFrame([(t,) for t in texts + [t for t, _ in rest] + broken], "value string").repartition(3)
    assert {(r["path"], r["kind"]): r["n"] for r in field_profile(df).collect()} == dict(want)
