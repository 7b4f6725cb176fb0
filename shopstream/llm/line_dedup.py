"""Line deduplication by range-partitioned line hashes, answered with per-document keep bitmaps.

Every line of a long enough key becomes a slim record (128-bit hash of the key, document, position).  The
records are range-partitioned and sorted by hash, then document, then position, so a very common line spans
as many partitions as it needs.  Each partition is streamed once: the first document of a run of equal
hashes keeps its lines, later ones lose theirs.  Only a partition's first run can have begun before it, and
of that run only the lines of its first document are in doubt; they are settled by a table of each
partition's first and last run, two rows a partition.  What is dropped comes back as one compressed bitmap
per document; no text is part of the search.

Defined results: null and empty texts are one empty line.  Rows with equal ids are one document to each
other (none loses a line to the other); a null id comes after all ids, and null ids are one document.  Equal
rows get equal bitmaps.  Lines of fewer than ``MIN_CHARS`` code points always stay.  Bytes are compared, so
texts that aren't valid UTF-8 only lose lines that are equal byte by byte after folding.  An empty table
gives an empty result.  Further input columns pass through ``deduplicated``; ``n_lines``, ``n_dropped`` and
``keep`` hold the operator's values there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .common import settled, table

MIN_CHARS = 10               # code points of a key that can be dropped
BLANK = b" \t\n\x0b\x0c\r"
ADDED = ("n_lines", "n_dropped", "keep")

RECORD = "hash binary, doc_id bigint, row binary, pos int"
FOUND = "kind tinyint, hash binary, doc_id bigint, row binary, pos int"
DROPPED, IN_DOUBT, RUN = 0, 1, 2     # kinds of found rows


def line_keys(text: bytes | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Position and key of every line whose key can be dropped."""
    for pos, line in enumerate((text or b"").split(b"\n")):
        key = line.strip(BLANK).lower()                 # of bytes: A-Z alone
        if len(key) >= 4 * min_chars or sum(b & 0xC0 != 0x80 for b in key) >= min_chars:
            yield pos, key


def _records(min_chars: int):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            hashes, at, pos = [], [], []
            for i, text in enumerate(texts):
                for p, key in line_keys(text.as_py(), min_chars):
                    hashes.append(xxhash.xxh3_128_digest(key))
                    at.append(i)
                    pos.append(p)
            at = pa.array(at, pa.int32())
            yield pa.record_batch([pa.array(hashes, pa.binary()), batch.column("doc_id").take(at),
                                   batch.column("row").take(at), pa.array(pos, pa.int32())],
                                  ["hash", "doc_id", "row", "pos"])
    return records


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams one sorted partition; holds a batch and the current run's hash and first document."""
    def rows(kind, hashes, docs, row, pos):
        n = len(docs)
        return pa.record_batch([pa.array(np.full(n, kind, np.int8)), hashes, docs, row, pos],
                               ["kind", "hash", "doc_id", "row", "pos"])

    def run(key, doc):
        return rows(RUN, pa.array([key], pa.binary()), pa.array([doc], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()))

    current = owner = head = None           # hash and first document of the current run; the partition's first hash
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        hashes, docs, row, pos = (batch.column(c) for c in ("hash", "doc_id", "row", "pos"))
        words = np.frombuffer(b"".join(hashes.to_pylist()), np.uint64).reshape(n, 2)
        doc, none = docs.fill_null(0).to_numpy(zero_copy_only=False), docs.is_null().to_numpy(zero_copy_only=False)
        starts = np.ones(n, bool)
        starts[1:] = (words[1:] != words[:-1]).any(axis=1)
        if head is None:
            head = current = hashes[0].as_py()
            owner = docs[0].as_py()
            yield run(head, owner)
        first = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        own_doc, own_none = doc[first], none[first]
        if hashes[0].as_py() == current:    # the run goes on from the batch before
            upto = int(np.argmax(starts[1:])) + 1 if starts[1:].any() else n
            own_doc[:upto], own_none[:upto] = (owner or 0), owner is None
        loses = (doc != own_doc) | (none != own_none)
        in_head = (words == np.frombuffer(head, np.uint64)).all(axis=1)
        for kind, where in ((DROPPED, loses), (IN_DOUBT, in_head & ~loses)):
            if where.any():
                where = pa.array(np.flatnonzero(where))
                got = [c.take(where) for c in (hashes, docs, row, pos)]
                yield rows(kind, *got)
        current, owner = hashes[n - 1].as_py(), None if own_none[-1] else int(own_doc[-1])
    if current is not None and current != head:
        yield run(current, owner)


@F.pandas_udf(BinaryType())
def _bitmap(positions: pd.Series) -> pd.Series:
    """Compressed keep bits, lowest bit first, up to the last dropped line; later lines are kept."""
    def packed(dropped):
        bits = np.ones(int(max(dropped)) + 1, bool)
        bits[np.asarray(dropped, np.int64)] = False
        return zlib.compress(np.packbits(bits, bitorder="little").tobytes())
    return positions.map(packed)


def keep_bits(body: bytes | None, upto: int, n: int) -> np.ndarray:
    """The keep flag of each of ``n`` lines; the bitmap ends with line ``upto`` (exclusive)."""
    kept = np.ones(n, bool)
    if body is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(body), np.uint8), bitorder="little", count=upto)
        kept[:upto] = bits.astype(bool)
    return kept


@F.pandas_udf(StringType())
def _kept(text: pd.Series, body: pd.Series, last: pd.Series) -> pd.Series:
    def kept(t, b, end):
        if b is None:
            return None
        lines = t.split("\n")
        return "\n".join([line for line, keep in zip(lines, keep_bits(b, int(end) + 1, len(lines))) if keep])
    return pd.Series([kept(*x) for x in zip(text, body, last)], dtype=object)


def row_key(text: Column) -> Column:
    """Tells rows with equal ids apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, row, pos of every line that goes."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", row_key(F.col("text")).alias("row"))
    records = settled(slim.mapInArrow(_records(min_chars), RECORD))      # the range sampling reads these, not the texts
    order = ["hash", F.col("doc_id").asc_nulls_last(), "row", "pos"]
    found = settled(records.repartitionByRange(*order).sortWithinPartitions(*order)
                    .mapInArrow(_first_occurrences, FOUND))
    known = found.filter(F.col("kind") == DROPPED).select("doc_id", "row", "pos")

    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    owners = (found.filter(F.col("kind") == RUN).groupBy(F.col("hash").alias("_hash"))
              .agg(F.min(rank).alias("_owner")))                         # two rows a partition at most
    doubt = found.filter(F.col("kind") == IN_DOUBT).join(F.broadcast(owners), F.col("hash") == F.col("_hash"))
    return known.unionByName(doubt.filter(F.col("_owner") < rank).select("doc_id", "row", "pos"))


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, row, n_dropped, last, keep of each document that loses lines.

    ``row`` is the text's md5, ``keep`` the compressed keep bits up to position ``last``, the last dropped line.
    """
    lines = dropped_lines(docs, min_chars).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("_pos"))
    return lines.select("doc_id", "row", F.size("_pos").cast("bigint").alias("n_dropped"),
                        F.array_max("_pos").alias("last"), _bitmap("_pos").alias("keep"))


def deduplicated(docs: DataFrame, bitmaps: DataFrame | None = None) -> DataFrame:
    """The documents with the kept lines as ``text``, and n_lines (before), n_dropped and keep (null: all stay)."""
    bitmaps = line_bitmaps(docs) if bitmaps is None else bitmaps
    rest = [c for c in docs.columns if c not in ADDED and c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    right = bitmaps.select(F.col("doc_id").alias("_id"), F.col("row").alias("_of"), F.col("n_dropped").alias("_n"),
                           "last", F.col("keep").alias("_keep")).withColumnRenamed("last", "_last").hint("shuffle_hash")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (row_key(F.col("text")) == F.col("_of"))
    body = F.when(F.col("_keep").isNotNull(), text)                      # other texts needn't travel to Python
    return docs.drop(*ADDED).join(right, same, "left").select(
        *rest, F.coalesce(_kept(body, F.col("_keep"), F.col("_last")), text).alias("text"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
        F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("n_dropped"), F.col("_keep").alias("keep"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, r, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key
), m AS (
  SELECT k.doc_id, r, pos, line, coalesce(k.doc_id IS DISTINCT FROM owner AND o.key IS NOT NULL, false) AS gone
  FROM k LEFT JOIN o ON k.key = o.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id, r
"""
