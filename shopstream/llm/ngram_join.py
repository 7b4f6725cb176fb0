"""Jaccard self-join on word n-grams by vertical partitioning.

The n-grams of all texts have one global order: by the number of sets that hold them, rare ones first,
then by hash.  The order is cut into fragments; what two sets share is counted fragment by fragment and
summed per pair.

* Texts of equal n-gram sets are one class; from here on classes are joined.
* Tasks turn their texts into chunks.  A chunk sends its n-grams to table partitions by key range, with
  the classes that hold them.  A partition counts how many hold each n-gram and answers with those that
  more than one holds: only these can be shared.  N-grams that many classes of a chunk hold are sent as
  a count, their holders go straight to where a chunk's answers meet, so that a frequent n-gram never
  brings its holders together.
* A class that holds fewer shared n-grams than any link needs is done.  Of the others, linking sets have
  an n-gram in common among the first size - needed + 1 of the global order (prefix filter).  Classes
  with such an n-gram in common form a group.  A group links its members to its least one only, so its
  rows stay linear in its size.  Connected groups are a family: all links are inside families.
* In a family, members that link with its busiest member are one component at once.  The others are
  compared in blocks: with each other and with the linked ones, by partial overlaps per fragment that
  are summed per pair.  Blocks hold a bounded number of sets and give back at most a spanning forest.

There are twice as many table partitions as the session's ``spark.sql.shuffle.partitions``; a task takes
one after the other.

Defined results: null, empty or blank texts have no n-grams and link with nothing.  Texts of fewer words
than ``n`` have one n-gram, the whole sequence.  Rows that repeat an id are judged each by its own text.
A null id counts as larger than any other.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import at_least, release_shuffles, settled, table
from .components import connected_components
from .packed import give_back, pack, pack_sorted, runs, slices, unpack, unpack_sorted
from .word_arrays import U, windows, word_hashes

N, PERCENT = 3, 90
CHUNK_GRAMS = 1 << 20        # n-grams of a chunk, about; a longer text is a chunk of its own
HOT = 64                     # holders in one chunk from which an n-gram is sent as a count
BLOCK = 256                  # sets of one side of a comparison
FRAGMENT = 2048              # n-grams of a fragment in a comparison


def ngram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for _, hashes, offsets in word_hashes(texts):
        grams = windows(hashes, n)
        for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if end - start >= n:
                yield np.unique(grams[start:end - n + 1])
            elif end > start:
                yield windows(hashes[start:end], end - start)
            else:
                yield np.empty(0, U)


def node_of(grams: np.ndarray) -> int:
    """A set's 64-bit fingerprint as a signed number."""
    x = xxhash.xxh3_64_intdigest(grams.tobytes())
    return x - (1 << 64) if x >> 63 else x


def least_shared(size: int, percent: int) -> int:
    """How many n-grams a set of this size shares with any set it links with, at least."""
    return -(-percent * size // 100)


# --- which n-grams are shared ---------------------------------------------------------------------

MESSAGE = "part int, chunk long, own boolean, body array<binary>"


class Sender:
    """Gathers texts into chunks and makes their messages."""

    def __init__(self, parts: int) -> None:
        self.parts, self.first = parts, TaskContext.get().partitionId() << 32
        self.start()

    def start(self) -> None:
        self.ids, self.sizes, self.nodes, self.classes, self.sets, self.held = [], [], [], {}, [], 0

    def add(self, doc_id: int | None, grams: np.ndarray) -> None:
        node = node_of(grams) if len(grams) else 0
        self.ids.append(doc_id)
        self.sizes.append(len(grams))
        self.nodes.append(node)
        if len(grams) and (node, len(grams)) not in self.classes:
            self.classes[node, len(grams)] = len(self.sets)
            self.sets.append(grams)
            self.held += len(grams)

    def messages(self) -> pa.RecordBatch:
        rows: list[tuple[int, bool, list[bytes]]] = []
        keys = np.concatenate([*self.sets, np.empty(0, U)])
        owners = np.repeat(np.arange(len(self.sets), dtype=np.uint32), [len(x) for x in self.sets])
        sized = np.array([[n, k[0]] for k, n in zip(self.classes, map(len, self.sets))], np.int64).reshape(-1, 2)
        self.sets = []
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        del order
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(new)
        counts = np.diff(starts, append=len(keys))
        hot = np.flatnonzero(counts > HOT)
        in_hot = np.repeat(counts > HOT, counts)
        hot_keys, hot_counts = keys[starts[hot]], counts[hot]
        del new, starts, counts
        known = np.array([x is not None for x in self.ids], bool)
        rows.append((self.first % self.parts, True, [
            pack(np.array([x or 0 for x in self.ids], np.int64)), pack(known), pack(np.array(self.sizes, np.int64)),
            pack(np.array(self.nodes, np.int64)), pack(sized[:, 0]), pack(sized[:, 1]),
            pack(hot_counts), pack(owners[in_hot])]))
        cold, cold_owners = (keys[~in_hot], owners[~in_hot]) if len(hot) else (keys, owners)
        bounds, hot_bounds = slices(cold, self.parts), slices(hot_keys, self.parts)
        for p in range(self.parts):
            a, b, c, d = bounds[p], bounds[p + 1], hot_bounds[p], hot_bounds[p + 1]
            if b > a or d > c:
                rows.append((p, False, [pack_sorted(cold[a:b]), pack(cold_owners[a:b]),
                                        pack_sorted(hot_keys[c:d]), pack(hot_counts[c:d])]))
        out = pa.RecordBatch.from_pydict({
            "part": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([self.first] * len(rows), pa.int64()),
            "own": pa.array([r[1] for r in rows], pa.bool_()), "body": pa.array([r[2] for r in rows], pa.list_(pa.binary()))})
        self.first += 1
        self.start()
        return out


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per table partition: of the n-grams sent, those that more than one class holds, back to their senders."""
    for group in runs(batches, ["part"]):
        senders, own = group.column("chunk").to_pylist(), group.column("own").to_pylist()
        bodies = group.column("body").to_pylist()
        sent = [(c, [unpack_sorted(b[0]), unpack(b[1], np.uint32), unpack_sorted(b[2]), unpack(b[3], np.int64)])
                for c, o, b in zip(senders, own, bodies) if not o]
        rows = [(c, True, b) for c, o, b in zip(senders, own, bodies) if o]
        if sent:
            index = np.unique(np.concatenate([x for _, s in sent for x in (s[0], s[2])]), return_inverse=True)[1]
            held = np.bincount(index)                              # a class each, or one count of many
            at = 0
            for _, (keys, _, hot, counts) in sent:
                at += len(keys)
                np.add.at(held, index[at:at + len(hot)], counts - 1)
                at += len(hot)
            at = 0
            for chunk, (keys, owners, hot, _) in sent:
                n = held[index[at:at + len(keys)]]
                of_hot = held[index[at + len(keys):at + len(keys) + len(hot)]]
                at += len(keys) + len(hot)
                shared = n > 1
                if shared.any() or len(hot):
                    rows.append((chunk, False, [pack_sorted(keys[shared]), pack(owners[shared]), pack(n[shared]),
                                                pack_sorted(hot), pack(of_hot)]))
        part = group.column("part")[0].as_py()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part] * len(rows), pa.int32()), "chunk": pa.array([r[0] for r in rows], pa.int64()),
            "own": pa.array([r[1] for r in rows], pa.bool_()), "body": pa.array([r[2] for r in rows], pa.list_(pa.binary()))})
    give_back()


KEPT = "doc_id long, size long, node long, prefix array<long>, grams binary"


def gathered(percent: int):
    """Per chunk: a row for each document, and one with the shared n-grams of each class that may link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["chunk"]):
            keys, owners, held, hot, hot_held = [], [], [], [], []
            own = None
            for mine, body in zip(group.column("own").to_pylist(), group.column("body").to_pylist()):
                if mine:
                    own = body
                    continue
                keys.append(unpack_sorted(body[0]))
                owners.append(unpack(body[1], np.uint32))
                held.append(unpack(body[2], np.int64))
                hot.append(unpack_sorted(body[3]))
                hot_held.append(unpack(body[4], np.int64))
            ids, known, sizes, nodes, class_sizes, class_nodes, hot_counts = (
                unpack(b, t) for b, t in zip(own, (np.int64, bool, np.int64, np.int64, np.int64, np.int64, np.int64)))
            if hot_counts.size:                                    # partitions are key ranges: in order they are ascending
                keys.append(np.repeat(np.concatenate(hot), hot_counts))
                held.append(np.repeat(np.concatenate(hot_held), hot_counts))
                owners.append(unpack(own[7], np.uint32))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64(), mask=~known), "size": pa.array(sizes, pa.int64()),
                "node": pa.array(nodes, pa.int64(), mask=sizes == 0),
                "prefix": pa.nulls(len(ids), pa.list_(pa.int64())), "grams": pa.nulls(len(ids), pa.binary())})
            if not keys:
                continue
            k, o, h = np.concatenate(keys), np.concatenate(owners), np.concatenate(held)
            order = np.lexsort((k, h, o))                          # each class in the global order
            k, o = k[order], o[order]
            ends = np.searchsorted(o, np.arange(len(class_sizes) + 1))
            rows = []
            for c, size in enumerate(class_sizes.tolist()):
                shared, needed = int(ends[c + 1] - ends[c]), least_shared(size, percent)
                if shared >= needed:
                    mine = k[ends[c]:ends[c + 1]]
                    rows.append((size, int(class_nodes[c]), mine[:shared - needed + 1].view(np.int64), np.sort(mine).tobytes()))
            if rows:
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.nulls(len(rows), pa.int64()), "size": pa.array([r[0] for r in rows], pa.int64()),
                    "node": pa.array([r[1] for r in rows], pa.int64()), "prefix": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                    "grams": pa.array([r[3] for r in rows], pa.binary())})
        give_back()
    return run


def shared_ngrams(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows of documents (doc_id, size, node) and of classes that may link (size, node, prefix, grams)."""
    parts = 2 * at_least(1, docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(parts)
        for batch in batches:
            for doc_id, grams in zip(batch.column("doc_id").to_pylist(), ngram_sets(batch.column("text"), n)):
                if sender.held and sender.held + len(grams) > CHUNK_GRAMS:
                    yield sender.messages()
                sender.add(doc_id, grams)
        if sender.ids:
            yield sender.messages()
        give_back()

    sent = docs.select("doc_id", "text").mapInArrow(send, MESSAGE)
    told = sent.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(answers, MESSAGE)
    return told.repartition(parts, "chunk").sortWithinPartitions("chunk", "part").mapInArrow(gathered(percent), KEPT)


# --- comparing sets -------------------------------------------------------------------------------

def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each left set shares with each right one: partial counts per fragment, summed."""
    total = np.zeros((len(left), len(right)), np.float32)
    if len(left) * len(right) <= 4:
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                total[i, j] = len(np.intersect1d(a, b, assume_unique=True))
        return total
    sides = []
    for sets in (left, right):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(flat, kind="stable")
        sides.append((flat[order], owner[order]))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    for at in range(0, len(shared), FRAGMENT):
        part = shared[at:at + FRAGMENT]
        matrices = []
        for (flat, owner), n in zip(sides, (len(left), len(right))):
            a, b = np.searchsorted(flat, part[0], "left"), np.searchsorted(flat, part[-1], "right")
            column = np.minimum(np.searchsorted(part, flat[a:b]), len(part) - 1)
            hit = part[column] == flat[a:b]
            matrix = np.zeros((n, len(part)), np.float32)
            matrix[owner[a:b][hit], column[hit]] = 1
            matrices.append(matrix)
        total += matrices[0] @ matrices[1].T
    return total


def links(shared: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs link, from what they share and the sizes of their sets."""
    shared = shared.astype(np.int64)
    return 100 * shared >= percent * (left[:, None] + right[None, :] - shared)


def sets_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), U) for x in column]


def with_pivot(members: DataFrame, percent: int) -> DataFrame:
    """(node, pivot): family members that link with their family's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = sets_of(batch.column("grams")), sets_of(batch.column("pivot_grams"))
            shared = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(own, other)], np.int64)
            sizes = batch.column("size").to_numpy() + batch.column("pivot_size").to_numpy()
            ok = 100 * shared >= percent * (sizes - shared)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("node", "pivot")}).filter(pa.array(ok, pa.bool_()))

    return members.select("node", "pivot", "size", "grams", "pivot_size", "pivot_grams").mapInArrow(run, "node long, pivot long")


def block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links in each comparison of two blocks.

    Rows of a comparison (family, i, j): sets of side 0, which meet those of side 1; without side 1 they
    meet each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["family", "i", "j", "resolved"]):
            side = group.column("side").to_numpy()
            if not (side == 0).any():
                continue
            nodes, sizes, sets = group.column("node").to_numpy(), group.column("size").to_numpy(), sets_of(group.column("grams"))
            left = np.flatnonzero(side == 0)
            alone = group.column("i")[0] == group.column("j")[0] and not group.column("resolved")[0].as_py()
            right = left if alone else np.flatnonzero(side == 1)
            if not len(right):
                continue
            shared = overlaps([sets[k] for k in left], [sets[k] for k in right])
            found = links(shared, sizes[left], sizes[right], percent)
            root = list(range(len(nodes)))

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            if group.column("resolved")[0].as_py():              # side 1 is one component
                for k in right[1:]:
                    root[k] = int(right[0])
            a, b = [], []
            for x, y in zip(*np.nonzero(found)):
                p, q = top(int(left[x])), top(int(right[y]))
                if p != q:
                    root[p] = q
                    a.append(nodes[left[x]])
                    b.append(nodes[right[y]])
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        give_back()

    keys = ["family", "i", "j", "resolved"]
    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys, "side", "node")
    return dealt.mapInArrow(run, "a long, b long")


def joined(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n_shingles, node), (linked: node, component), the latter for linked classes only."""
    kept = settled(shared_ngrams(docs, n, percent))
    release_shuffles(docs.sparkSession)
    documents = kept.filter("grams is null").select("doc_id", F.col("size").alias("n_shingles"), "node")
    classes = kept.filter("grams is not null").dropDuplicates(["node"])        # equal sets have equal rows

    # groups: classes with an n-gram of their prefixes in common; each member meets the least one
    order = W.partitionBy("key").orderBy("node").rowsBetween(W.unboundedPreceding, W.currentRow)
    agree = (classes.select(F.explode("prefix").alias("key"), "node")
             .withColumn("least", F.min("node").over(order)).filter("node != least"))
    agree = settled(agree.groupBy("least", "node").agg(F.count(F.lit(1)).alias("n_agree")))
    families = settled(connected_components(agree, "least", "node"))

    busy = (agree.select(F.col("least").alias("node"), "n_agree").unionByName(agree.select("node", "n_agree"))
            .groupBy("node").agg(F.sum("n_agree").alias("n")))
    pivots = (families.join(busy, "node").groupBy("component")
              .agg(F.max_by("node", F.struct("n", "node")).alias("pivot")))
    members = families.join(pivots, "component").select("node", F.col("component").alias("family"), "pivot")
    members = settled(classes.select("node", "size", "grams").join(members, "node"))

    of_pivot = members.filter("node = pivot").select(
        F.col("family").alias("_f"), F.col("size").alias("pivot_size"), F.col("grams").alias("pivot_grams"))
    release_shuffles(docs.sparkSession)
    direct = settled(with_pivot(members.filter("node != pivot").join(of_pivot, F.col("family") == F.col("_f")), percent))
    near = direct.select("node", F.lit(True).alias("_near"))
    state = members.select("node", "family", "pivot").join(near, "node", "left").withColumn(
        "resolved", F.coalesce("_near", F.col("node") == F.col("pivot")))

    # blocks of a family: members are dealt by hash into ceil(count / BLOCK) blocks of either kind
    sizes = state.groupBy("family").agg(F.sum(F.col("resolved").cast("int")).alias("n1"), F.sum((~F.col("resolved")).cast("int")).alias("n0"))
    sizes = sizes.filter("n0 > 0").select(
        "family", F.ceil(F.col("n0") / BLOCK).alias("b0"), F.ceil(F.col("n1") / BLOCK).alias("b1"))
    state = settled(state.join(sizes, "family").select(
        "node", "resolved", "b0", "b1",
        F.pmod(F.xxhash64("node"), F.when(F.col("resolved"), F.col("b1")).otherwise(F.col("b0"))).alias("block")))
    blocks = members.select("node", "family", "size", "grams").join(state, "node")
    last = F.col("b0") - 1
    # open members meet each other: block i with every block j >= i
    own = blocks.filter("not resolved").select("node", "family", "size", "grams", "block", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("o"))
    own = own.select("node", "family", "size", "grams", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"),
                     F.lit(False).alias("resolved"), (F.col("block") > F.col("o")).cast("int").alias("side"))
    # and the linked ones
    across = blocks.filter("not resolved").select("node", "family", "size", "grams", F.col("block").alias("i"),
                                                  F.explode(F.sequence(F.lit(0).cast("long"), F.col("b1") - 1)).alias("j"),
                                                  F.lit(True).alias("resolved"), F.lit(0).alias("side"))
    linked = blocks.filter("resolved").select("node", "family", "size", "grams", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"),
                                              F.col("block").alias("j"), F.lit(True).alias("resolved"), F.lit(1).alias("side"))
    found = block_links(own.unionByName(across).unionByName(linked), percent)
    edges = found.unionByName(direct.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    return documents, settled(connected_components(edges, "a", "b"))


def ngram_jaccard_join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id reachable by links), node (class of equal sets), component."""
    documents, linked = joined(docs, n, percent)
    classes = documents.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("_id"))
    classes = classes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = classes.groupBy("component").agg(F.min("_id").alias("component_id"))
    classes = classes.join(ids, "component").select(F.col("node").alias("_node"), "component", "component_id")
    return documents.join(classes, F.col("node") == F.col("_node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node", "component")


def one_of_each(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one: that of the least id.

    Texts without n-grams are in no component and stay.  Of rows with equal id and n-grams the least by
    the other columns stays.  Rows are found again by their id; only where an id has several rows that
    don't all go are their n-grams looked at once more.
    """
    found = ngram_jaccard_join(docs, n, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("_first")
    stays = found.filter("node is not null").groupBy("component").agg(first).select(
        F.col("component").alias("_c"), F.col("_first.doc_id").alias("_id"), F.col("_first.node").alias("_stays"))
    judged = found.join(stays, F.col("component") == F.col("_c"), "left")
    stay = F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("node") == F.col("_stays")))
    ids = settled(judged.groupBy(F.col("doc_id").alias("_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(stay).alias("n_stay"), F.count("node").alias("n_texts")).filter(
        "n_stay < n or (n > 1 and n_texts > 0)"))
    other = ids.select(F.col("_id").alias("_other")).hint("shuffle_hash")
    kept = docs.join(other, F.col("doc_id").eqNullSafe(F.col("_other")), "left_anti")
    mixed = ids.filter("n_stay > 0").select(F.col("_id").alias("_mixed"))
    if mixed.isEmpty():
        return kept

    @F.pandas_udf("long")
    def nodes(texts: pd.Series) -> pd.Series:
        grams = ngram_sets(pa.array(texts, pa.string(), from_pandas=True), n)
        return pd.Series([node_of(g) if len(g) else None for g in grams], dtype="Int64")

    again = docs.join(mixed.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_mixed")), "left_semi")
    again = again.withColumn("_node", nodes(F.coalesce("text", F.lit(""))))
    again = again.join(stays, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_stays")), "left")
    order = W.partitionBy("doc_id", "_node").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")], "text")
    again = again.withColumn("_row", F.row_number().over(order)).filter(
        "_node is null or (_stays is not null and _row = 1)")
    return kept.unionByName(again.select(*docs.columns))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents", "doc_id", "text")).drop("node", "component")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS g
  FROM w, unnest(range(1, greatest(len(w) - 1, 2))) AS x(i) WHERE len(w) > 0
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), sets AS (
  SELECT r, doc_id, md5(string_agg(g::VARCHAR, chr(10) ORDER BY g)) AS c, count(*) AS n FROM s GROUP BY r, doc_id
), classes AS (
  SELECT c, min(r) AS r, min(doc_id) AS doc_id, min(n) AS n FROM sets GROUP BY c
), pairs AS (
  SELECT a.r AS x, b.r AS y, count(*) AS k
  FROM s a JOIN classes ca ON ca.r = a.r JOIN s b ON b.g = a.g AND b.r > a.r JOIN classes cb ON cb.r = b.r
  WHERE 10 * ca.n >= 9 * cb.n AND 10 * cb.n >= 9 * ca.n
  GROUP BY a.r, b.r
), links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)
), both_ways AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT r AS x, r AS y FROM classes UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.y
), least AS (
  SELECT x, min(classes.doc_id) AS component_id FROM reach JOIN classes ON classes.r = reach.y GROUP BY x
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (r) LEFT JOIN sets ON sets.r = w.r LEFT JOIN classes ON classes.c = sets.c LEFT JOIN least ON least.x = classes.r
"""
