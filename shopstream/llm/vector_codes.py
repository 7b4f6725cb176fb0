"""Product codes of vectors by an exact dual-tree Lloyd iteration on integers.

Vectors are floored to integers and cut into parts.  Tasks pack them into chunks of at most ``CHUNK`` vectors;
a chunk holds, for each part position, a balanced tree over its parts with boxes and cached sums, and is
written once.  Every round reads the chunks, walks their trees against a tree over the position's codebook
(see ``dual_tree``: node pairs are pruned by distance bounds, nodes with one entry left are assigned whole by
their cached sums, the points of uncertain leaves by integer distances) and sends one row of sums per task and
entry.  The driver holds the codebooks alone: ``parts x entries`` rows, whatever the number of vectors.

Defined results: vectors that are null or hold null, NaN or infinite components give no row.  Vectors shorter
than the longest one (rounded up to equal parts) are filled up with zeros; components beyond the integers that
give exact squares (2^28 for parts of 16) stop there.  Rows are told apart by nothing but their place, so
repeated ids all count and all get a row; the first codebook takes equal ids by their components, and rows
without an id after all others.  With fewer vectors than entries the codebook has one entry per vector.
An empty table gives an empty result.  Only the id, the vector and the label column are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dual_tree
from .common import salted_lookup, settled, table

SCALE = 1024                 # of a component before it is floored
PARTS, ENTRIES, ROUNDS = 4, 256, 4
CHUNK = 4096                 # vectors of a chunk at most

CHUNKS = ("ids array<bigint>, labels array<bigint>, points array<binary>, orders array<binary>, "
          "lo array<binary>, hi array<binary>, sums array<binary>")


def is_vector(vector: Column) -> Column:
    """True for vectors whose components are all finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def limit(width: int) -> int:
    """The largest integer of a component: squares, their sums over a part and their differences are exact."""
    return 1 << (60 - max(width - 1, 1).bit_length()) // 2


def integers(flat: np.ndarray, offsets: np.ndarray, width: int, parts: int, scale: int) -> np.ndarray:
    """One row of ``parts * width`` integers per vector, zeros after its end."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    most = limit(width)
    whole = np.clip(np.floor(flat.astype(np.float64) * scale), -most, most).astype(np.int64)
    out = np.zeros((n, parts * width), np.int64)
    row = np.repeat(np.arange(n), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = whole
    return out


def _chunks(width: int, parts: int, scale: int, chunk: int):
    def body(arrays) -> bytes:
        return np.concatenate(arrays).astype("<i8").tobytes()

    def packed(ids, labels, rows) -> pa.RecordBatch:
        points, orders, lo, hi, sums = [], [], [], [], []
        for k in range(parts):
            part = rows[:, k * width:(k + 1) * width]
            tree = dual_tree.build(part)
            points.append(part[tree.order].astype("<i4").tobytes())
            orders.append(tree.order.astype("<i4").tobytes())
            for to, what in ((lo, tree.lo), (hi, tree.hi), (sums, tree.sums)):
                to.append(body(what))
        schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64()))]
                           + [(c, pa.list_(pa.binary())) for c in ("points", "orders", "lo", "hi", "sums")])
        values = [ids.to_pylist(), labels.to_pylist(), points, orders, lo, hi, sums]
        return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, chunk):
                some = batch.slice(a, chunk)
                vectors = some.column("vector")
                offsets = vectors.offsets.to_numpy(zero_copy_only=False)
                flat = vectors.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
                yield packed(some.column("id"), some.column("label"), integers(flat, offsets, width, parts, scale))
    return chunks


class _Chunk:
    """One row of the chunk table, opened."""

    def __init__(self, row: dict, width: int, parts: int):
        self.n, self.width = len(row["ids"]), width
        self.ids, self.labels = row["ids"], row["labels"]
        self.row, self.parts = row, parts

    def position(self, k: int) -> tuple[np.ndarray, dual_tree.Tree]:
        """The points of a part position in tree order, and their tree."""
        def nodes(body: bytes) -> list[np.ndarray]:
            flat = np.frombuffer(body, "<i8").reshape(-1, self.width)
            return [flat[(1 << level) - 1:(2 << level) - 1] for level in range(dual_tree.levels_of(self.n, dual_tree.LEAF) + 1)]

        points = np.frombuffer(self.row["points"][k], "<i4").astype(np.int64).reshape(self.n, self.width)
        order = np.frombuffer(self.row["orders"][k], "<i4").astype(np.int64)
        return points, dual_tree.Tree(order, nodes(self.row["lo"][k]), nodes(self.row["hi"][k]), nodes(self.row["sums"][k]))


def _opened(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[_Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Chunk(batch.slice(i, 1).to_pylist()[0], width, parts)


def _first(width: int, parts: int, entries: int):
    """The vectors of the least ids of each chunk."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _opened(batches, width, parts):
            rows = np.empty((chunk.n, parts * width), np.int64)
            for k in range(parts):
                points, tree = chunk.position(k)
                rows[tree.order, k * width:(k + 1) * width] = points
            at = sorted(range(chunk.n), key=lambda i: (chunk.ids[i] is None, chunk.ids[i] or 0, rows[i].tolist()))[:entries]
            yield pa.record_batch([pa.array([chunk.ids[i] for i in at], pa.int64()),
                                   pa.array(list(rows[at]), pa.list_(pa.int64()))], ["id", "vector"])
    return first


def _sums(books: np.ndarray):
    """Count and component sums of every entry that got points in this task."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for chunk in _opened(batches, width, parts):
            for k in range(parts):
                def whole(entry, node_sums, n, base=k * entries):
                    np.add.at(total, base + entry, node_sums)
                    np.add.at(count, base + entry, n)
                points, tree = chunk.position(k)
                dual_tree.assign(points, tree, books[k], whole)
        used = np.flatnonzero(count)
        if len(used):
            yield pa.record_batch([pa.array(x) for x in (used, count[used], *total[used].T)],
                                  ["entry", "n", *(f"s{i}" for i in range(width))])
    return sums


def _codes(books: np.ndarray):
    parts, _, width = books.shape

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _opened(batches, width, parts):
            got, error = np.empty((chunk.n, parts), np.uint8), np.zeros(chunk.n, np.int64)
            for k in range(parts):
                points, tree = chunk.position(k)
                entry = dual_tree.assign(points, tree, books[k])
                off = points - books[k][entry]
                got[tree.order, k] = entry
                error[tree.order] += np.einsum("ij,ij->i", off, off)
            yield pa.record_batch([pa.array(chunk.ids, pa.int64()), pa.array(chunk.labels, pa.int64()),
                                   pa.array([row.tobytes().hex() for row in got]), pa.array(error)],
                                  ["id", "label", "code", "error"])
    return codes


def _long(columns: list[str]) -> str:
    return ", ".join(f"{c} bigint" for c in columns)


def vector_chunks(df: DataFrame, id_: str, vector: str, label: str, parts: int, scale: int = SCALE,
                  chunk: int = CHUNK) -> tuple[DataFrame, int]:
    """The written chunk table of the kept vectors, and the components of a part."""
    kept = df.select(F.col(id_).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
                     F.col(vector).cast("array<double>").alias("vector")).filter(is_vector(F.col("vector")))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    return settled(kept.mapInArrow(_chunks(width, parts, scale, chunk), CHUNKS)), width


def lloyd(chunks: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """The codebooks (part, entry, component) after ``rounds`` rounds; None without vectors."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is two hex digits a part: 1 to 256 entries")
    first = (chunks.mapInArrow(_first(width, parts, entries), "id bigint, vector array<bigint>")
             .orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect())
    if not first:
        return None
    books = np.array([r["vector"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    columns = ["n", *(f"s{i}" for i in range(width))]
    for _ in range(rounds):
        sums = chunks.mapInArrow(_sums(books), _long(["entry", *columns])).groupBy("entry").agg(
            *[F.sum(c).alias(c) for c in columns])
        for row in sums.collect():                       # a row per part position and entry at most
            k, entry = divmod(row["entry"], books.shape[1])
            books[k, entry] = [row[c] // row["n"] for c in columns[1:]]
    return books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, chunk: int = CHUNK) -> DataFrame:
    """id, label, code, error (squared, over the parts), label_error and codebooks_sha256 of every kept vector."""
    chunks, width = vector_chunks(df, id_, vector, label, parts, scale, chunk)
    books = lloyd(chunks, width, parts, entries, rounds)
    digest = None if books is None else books_digest(books)
    books = np.zeros((parts, 1, width), np.int64) if books is None else books
    coded = settled(chunks.mapInArrow(_codes(books), "id bigint, label bigint, code string, error bigint"))
    errors = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return (salted_lookup(coded, errors, "label", F.col("id"))
            .select(F.col("id").alias(id_), F.col("label").alias(label), "code", "error", "label_error",
                    F.lit(digest).cast("string").alias("codebooks_sha256")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return vector_codes(vectors).drop("label")


def _sql(width: int = 16) -> str:
    """The rounds written out one after another: plain nearest entries, no trees."""
    steps = [f"""
raw AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER () AS r,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), part AS MATERIALIZED (
  SELECT r, p, list_slice(v, p * {width} + 1, p * {width} + {width}) AS x FROM raw, range({PARTS}) t(p)
), b0 AS MATERIALIZED (
  SELECT p, e - 1 AS e, list_slice(v, p * {width} + 1, p * {width} + {width}) AS z
  FROM (SELECT v, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS e FROM raw) f, range({PARTS}) t(p)
  WHERE e <= {ENTRIES}
)"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(d := d, e := e)) AS best, any_value(x) AS x FROM (
    SELECT r, part.p, e, x, list_sum(list_transform(list_zip(x, z), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::BIGINT AS d
    FROM part JOIN b{i} ON part.p = b{i}.p) GROUP BY r, p
)""")
        if i < ROUNDS:
            steps.append(f"""
b{i + 1} AS MATERIALIZED (
  SELECT b{i}.p, b{i}.e, coalesce(m.z, b{i}.z) AS z FROM b{i} LEFT JOIN (
    SELECT p, e, list(c ORDER BY k) AS z FROM (
      SELECT p, best.e AS e, k, floor_div(sum(x[k])::BIGINT, count(*)) AS c
      FROM a{i}, range(1, {width + 1}) t(k) GROUP BY p, best.e, k) GROUP BY p, e) m ON m.p = b{i}.p AND m.e = b{i}.e
)""")
    last = ROUNDS
    text = "WITH " + ",".join(steps) + f"""
, s AS (
  SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256
  FROM (SELECT p, e, array_to_string(z, ',') AS t FROM b{last})
), c AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{last} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM c JOIN raw USING (r), s
"""
    # DuckDB's // truncates: floors go down
    return text.replace("floor_div(sum(x[k])::BIGINT, count(*))",
                        "((sum(x[k])::BIGINT - (((sum(x[k])::BIGINT % count(*)) + count(*)) % count(*))) // count(*))")


SQL = _sql()
