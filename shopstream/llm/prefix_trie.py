"""The trie of conversation prefixes, by digests of fixed-length blocks of turns.

A conversation is cut into blocks of ``BLOCK`` turns.  Every block row carries the digests of its turns and a
prefix value of the blocks before it (sums of four position-salted 36-bit hashes), so two conversations share
their first k blocks exactly when those values agree.  Conversations are grouped by whole blocks first.  A
parent prefix with a single next block needs no look inside it: the block's turns are one chain of nodes.
Where sibling blocks diverge, and only there, the *distinct* blocks (not the conversations) are taken apart
into turns and grouped by their prefixes inside the block.  Both give segments: chains of nodes that the same
conversations pass.  Subtree sums run over segments by pointer doubling, so a path of n segments takes
log2(n) rounds.

No group is gathered: places and prefix values within a conversation come from range partitions plus their
offsets, counts are partial sums, and the ids that end at a node are sorted over ranges, packed, and streamed
through the node's SHA-256 (the hash itself is sequential by definition; it holds one packed row at a time).

Defined results: rows without a conv_id are in no conversation.  Null roles and texts are empty.  Equal turns
of a conversation are ordered by role, then by the text's md5; a null turn comes first.  Equal rows are
separate turns.  A table without conversations gives an empty result.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, settled, table

BLOCK = 4                    # turns of a block
SHARED = 20                  # conversations that may share their beginning
PACKED_IDS = 8192            # ids in a packed row at most
PIECES = ("p0", "p1", "p2", "p3")
PIECE_SHIFT = 28             # 64 - 36 bits: sums of 2^27 blocks stay exact

NODES = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
         "saved_tokens bigint, ends_sha256 string")
ROOT = hashlib.md5(b"root").digest()
NO_IDS = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, key: str, order: list, sums: dict[str, Column]) -> DataFrame:
    """``df`` with inclusive running sums within ``key`` by ``order``, without a task that holds a whole key.

    Rows are ranged by key and order; a window adds up within each range, and the few keys that go over a
    range's border (one a range at most) get what lies before from a table of range totals.
    """
    placed = settled(df.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy(key, "_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    ahead = W.partitionBy(key).orderBy("_part")
    before = ahead.rowsBetween(W.unboundedPreceding, -1)
    offsets = (totals.select(F.col(key).alias("_key"), F.col("_part").alias("_in"), F.row_number().over(ahead).alias("_nth"),
                             *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums])
               .filter("_nth > 1").drop("_nth"))                          # a row per range at most
    inside = W.partitionBy("_part", key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = placed.withColumns({f"_s_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    rows = rows.join(F.broadcast(offsets), (F.col("_part") == F.col("_in")) & (F.col(key) == F.col("_key")), "left")
    return rows.select(*df.columns, *[(F.col(f"_s_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in sums])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """c, i (place from 0), t (digest of role and text), words of every turn."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    slim = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("c"), F.col("turn").alias("at"), role.alias("role"), F.md5(text).alias("x"),
        F.when(F.length(bare) == 0, 0).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("bigint").alias("words"))
    order = [F.col("at").asc_nulls_first(), F.col("role"), F.col("x")]
    placed = running(slim, "c", order, {"nth": F.lit(1).cast("bigint")})
    return placed.select("c", (F.col("nth") - 1).alias("i"), F.unhex(F.md5(F.concat("role", "x"))).alias("t"), "words")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation with the beginning of the first of its twenty: (c, pos, t, words), and (c, length)."""
    taken = F.crc32(F.col("c").cast("string")) % 4
    convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    heads = turns.filter((F.col("c") % SHARED == 0) & (F.col("i") < 3)).select(F.col("c").alias("_c"), "i", "t", "words")
    sizes = convs.filter(F.col("c") % SHARED == 0).select(F.col("c").alias("_c"), F.least(F.col("n"), F.lit(3)).alias("_n"))
    plan = (convs.withColumn("h", taken).withColumn("base", F.col("c") - F.col("c") % SHARED)
            .join(sizes, F.col("base") == F.col("_c"), "left")
            .select("c", "h", "base", F.least("h", F.coalesce("_n", F.lit(0))).alias("got"), "n"))
    plan = settled(plan)
    begin = plan.join(heads, (F.col("base") == F.col("_c")) & (F.col("i") < F.col("h"))).select(
        "c", F.col("i").alias("pos"), "t", "words")
    # where the first conversation holds as many turns as are taken, nothing moves and no join is needed
    own = turns.withColumn("h", taken).filter("i >= h").select("c", "i", "t", "words", "h")
    short = plan.filter("got < h").select(F.col("c").alias("_c"), (F.col("h") - F.col("got")).alias("less"))
    rest = own.join(short, F.col("c") == F.col("_c"), "left").select(
        "c", (F.col("i") - F.coalesce("less", F.lit(0))).alias("pos"), "t", "words")
    lengths = plan.select("c", (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return begin.unionByName(rest), lengths


def _digest(*parts) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *parts)))


def _inside(turns: Column, j: Column) -> Column:
    """Digest of the first j turns of a block."""
    return F.md5(F.concat_ws("", F.transform(F.slice(turns, 1, j), lambda x: F.hex(x["t"]))))


def _node(k: Column, j: Column, block: int, before: list[Column], through: list[Column], inside: Column) -> Column:
    """Key of the node after j turns of block k: whole blocks are named by their prefix value alone."""
    return F.when(j == block, _digest(k + 1, *through)).otherwise(_digest(k, *before, j, inside))


def block_rows(rebuilt: DataFrame, block: int = BLOCK) -> DataFrame:
    """c, k, turns (in order) and, before and through the block, the prefix values; the node keys of both ends."""
    k = F.floor(F.col("pos") / block)
    rows = (rebuilt.groupBy("c", k.alias("k"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", "t", "words"))).alias("turns"))
            .withColumn("turns", F.transform("turns", lambda x: F.struct(x["t"].alias("t"), x["words"].alias("words")))))
    whole = _inside(F.col("turns"), F.size("turns"))
    hashes = {p: F.shiftrightunsigned(F.xxhash64(F.lit(p), F.col("k"), F.col("b")), PIECE_SHIFT) for p in PIECES}
    rows = rows.withColumn("b", whole).withColumns({f"g{p}": h for p, h in hashes.items()})
    rows = running(rows, "c", [F.col("k")], {p: F.col(f"g{p}") for p in PIECES})
    through = [F.col(p) for p in PIECES]
    before = [F.col(p) - F.col(f"g{p}") for p in PIECES]
    up = F.when(F.col("k") == 0, F.lit(ROOT)).otherwise(_digest(F.col("k"), *before))
    key = _node(F.col("k"), F.size("turns"), block, before, through, F.col("b"))
    return rows.select("c", "k", "turns", up.alias("up"), key.alias("key"),
                       *[b.alias(f"b{p}") for b, p in zip(before, PIECES)], *PIECES)


def segments(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """key (of the last node), up (of the node above), depth (of the first node), words, n_convs, conv_id."""
    alike = ["k", "turns", "up", "key", *[f"b{p}" for p in PIECES], *PIECES]
    nodes = settled(blocks.groupBy(*alike).agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id")))
    siblings = nodes.groupBy(F.col("up").alias("_up")).agg(F.count(F.lit(1)).alias("_siblings"))
    nodes = nodes.join(siblings, F.col("up") == F.col("_up"))
    straight = nodes.filter("_siblings = 1").select(
        "key", "up", (F.col("k") * block + 1).alias("depth"), F.col("turns.words").alias("words"), "n_convs", "conv_id")
    before, through = [F.col(f"b{p}") for p in PIECES], [F.col(p) for p in PIECES]

    def name(j):
        return _node(F.col("k"), j, block, before, through, _inside(F.col("turns"), j))

    # blocks whose siblings diverge, turn by turn
    steps = nodes.filter("_siblings > 1").select("*", F.posexplode("turns").alias("_j", "_turn")).withColumn("_j", F.col("_j") + 1)
    steps = steps.select(name(F.col("_j")).alias("key"),
                         F.when(F.col("_j") == 1, F.col("up")).otherwise(name(F.col("_j") - 1)).alias("up"),
                         (F.col("k") * block + F.col("_j")).alias("depth"), F.col("_turn.words").alias("w"), "n_convs", "conv_id")
    split = (steps.groupBy("key", "up", "depth", "w").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
             .select("key", "up", "depth", F.array("w").alias("words"), "n_convs", "conv_id"))
    return straight.unionByName(split)


def subtree_sums(rows: DataFrame, sums: list[str]) -> DataFrame:
    """key and, for each of ``sums``, the total over the row and all rows below it; ``up`` is null at the top.

    After r rounds a row knows the rows less than 2^r steps below it and the row 2^r steps above it.
    """
    state = settled(rows.select("key", "up", *sums))
    while not state.filter(F.col("up").isNotNull()).isEmpty():
        more = (state.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("_to"))
                .agg(*[F.sum(s).alias(f"_{s}") for s in sums]))
        above = state.filter(F.col("up").isNotNull()).select(F.col("key").alias("_above"), F.col("up").alias("_next"))
        state = settled(state.join(more, F.col("key") == F.col("_to"), "left")
                        .join(above, F.col("up") == F.col("_above"), "left")
                        .select("key", F.col("_next").alias("up"),
                                *[(F.col(s) + F.coalesce(F.col(f"_{s}"), F.lit(0))).alias(s) for s in sums]))
    return state.drop("up")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of consecutive rows of one key, comma-joined."""
    def row(key, ids):
        return pa.record_batch([pa.array([key], pa.binary()), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])],
                               ["key", "first", "ids"])

    key, ids = None, []
    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("c").to_pylist()):
            if ids and (k != key or len(ids) == PACKED_IDS):
                yield row(key, ids)
                ids = []
            key = k
            ids.append(c)
    if ids:
        yield row(key, ids)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's packed rows in order; holds the state of one hash."""
    def row(key, state):
        return pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    key = state = None
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if state is not None:
                    yield row(key, state)
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        yield row(key, state)


def ends_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids (c) at each key, ascending, in decimal, comma-joined."""
    packed = (ends.repartitionByRange("key", "c").sortWithinPartitions("key", "c")
              .mapInArrow(_packed, "key binary, first bigint, ids string"))
    return (packed.repartition("key").sortWithinPartitions("key", "first")
            .mapInArrow(_hashed, "key binary, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rebuilt, lengths = rebuilt_turns(settled(ordered_turns(conversations)))
    blocks = settled(block_rows(rebuilt, block))
    segs = settled(segments(blocks, block))

    children = settled(segs.groupBy(F.col("up").alias("_key")).agg(F.count(F.lit(1)).alias("n_children")))
    segs = settled(segs.join(children, F.col("key") == F.col("_key"), "left").drop("_key").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)),
        "own": (F.col("n_convs") - 1) * F.aggregate("words", F.lit(0).cast("bigint"), lambda a, x: a + x)}))
    below = subtree_sums(segs.select(
        "key", F.nullif(F.col("up"), F.lit(ROOT)).alias("up"), (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
        F.col("own").alias("saved")), ["n_leaves", "saved"])

    last = blocks.groupBy("c").agg(F.max_by("key", "k").alias("key"))
    none = lengths.filter("length = 0").select("c", F.lit(ROOT).alias("key"))
    ends = settled(ends_digests(last.unionByName(none)))

    # the root: three rows of totals reach the driver
    convs = lengths.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    whole = segs.agg(F.count_if(F.col("up") == F.lit(ROOT)).alias("n_children"), F.count_if(F.col("n_children") == 0).alias("n_leaves"),
                     F.coalesce(F.sum("own"), F.lit(0)).alias("saved")).first()
    here = ends.filter(F.col("key") == F.lit(ROOT)).first()
    top = [(convs["conv_id"], 0, None, convs["n_convs"], whole["n_children"], max(1, whole["n_leaves"]), whole["saved"],
            here["ends_sha256"] if here else NO_IDS)] if convs["n_convs"] else []

    parents = segs.select(F.col("key").alias("_up"), F.col("conv_id").alias("parent"))
    nodes = (segs.join(below.withColumnRenamed("key", "_below"), F.col("key") == F.col("_below"))
             .join(ends.withColumnRenamed("key", "_end"), F.col("key") == F.col("_end"), "left")
             .join(parents, F.col("up") == F.col("_up"), "left")
             .withColumn("parent", F.coalesce("parent", F.lit(convs["conv_id"]).cast("bigint"))))
    steps = nodes.select("*", F.size("words").alias("_n"), F.posexplode("words").alias("_j", "_w"))
    passed = F.aggregate(F.slice("words", 1, F.col("_j")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    end = F.col("_j") == F.col("_n") - 1
    steps = steps.select(
        "conv_id", (F.col("depth") + F.col("_j")).cast("bigint").alias("depth"),
        F.when(F.col("_j") == 0, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(end, F.col("n_children")).otherwise(F.lit(1)).cast("bigint").alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * passed).alias("saved_tokens"),
        F.when(end, F.coalesce("ends_sha256", F.lit(NO_IDS))).otherwise(F.lit(NO_IDS)).alias("ends_sha256"))
    return segs.sparkSession.createDataFrame(top, NODES).unionByName(steps)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


SQL = r"""
WITH t AS (
  SELECT conv_id AS c, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS d,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS w,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (
  SELECT c, list({'d': d, 'w': w} ORDER BY i) AS s FROM t GROUP BY c
), h AS (  -- crc32 of the decimal id, bit by bit
  SELECT c, s, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
             lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END))) % 4 AS h FROM l
), r AS (
  SELECT h.c, list_concat(coalesce(list_slice(b.s, 1, h), []), list_slice(h.s, h + 1, len(h.s))) AS s
  FROM h LEFT JOIN l b ON b.c = h.c - h.c % 20
), m AS (
  SELECT c, n, md5(array_to_string(list_transform(list_slice(s, 1, n), lambda x: x.d), '')) AS k,
         CASE WHEN n > 0 THEN md5(array_to_string(list_transform(list_slice(s, 1, n - 1), lambda x: x.d), '')) END AS up,
         CASE WHEN n > 0 THEN s[n].w ELSE 0 END AS w, n = len(s) AS ends
  FROM (SELECT c, s, unnest(range(len(s) + 1)) AS n FROM r)
), v AS (
  SELECT n, k, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY n, k
), ch AS (
  SELECT n - 1 AS n, up AS k, count(*) AS n_children FROM v WHERE n > 0 GROUP BY ALL
), a AS (
  SELECT m.n, m.k, sum(CASE WHEN ch.k IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved_tokens
  FROM v LEFT JOIN ch ON v.n = ch.n AND v.k = ch.k JOIN m ON m.c = v.conv_id AND m.n <= v.n GROUP BY m.n, m.k
)
SELECT v.conv_id, v.n::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs,
       coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
       v.ends_sha256
FROM v JOIN a ON a.n = v.n AND a.k = v.k LEFT JOIN ch ON ch.n = v.n AND ch.k = v.k
LEFT JOIN v p ON p.n = v.n - 1 AND p.k = v.up
"""
