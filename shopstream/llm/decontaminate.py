"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased words without punctuation.  A seed is the hash of the tokens that a fixed mask
selects from consecutive ones; the others may differ.  Seeds of all document windows meet those
of the benchmark items.  A hit fixes a diagonal (document position less item position); along it the two
token sequences are compared over the whole item, and the best stretch counts: matches less mismatches.
Substituted words thus cost one each, wherever they are.  The masks give a seed to every stretch that
scores ``MIN_SCORE`` and has up to one substituted token in three.

A document is contaminated by an item if the best stretch scores ``MIN_SCORE`` and ``MIN_SHARE`` of the
item (of its first ``FULL`` tokens' number, if it is longer).

Defined results: null, empty or blank texts and items have no tokens.  Items of fewer than
``MIN_SCORE`` tokens can't score it and contaminate nothing.  Rows that repeat an id are judged together, the result has one row
per (doc_id, item_id); null ids are ids like any other.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, settled, table

# 1: the token counts, 0: it may differ; none is longer than MIN_SCORE.  No smaller set of spaced masks of four
# tokens has a seed for every stretch with one substituted token in three (found by trying all).
MASKS = ("10111", "101101", "110011")
MIN_SCORE, MIN_SHARE, FULL = 7, 0.4, 32
BROADCAST_SEEDS = 1_000_000          # more benchmark seeds than this are joined by a shuffle


def token_hashes(text: Column) -> Column:
    """Hashes of the tokens of a text, in order; null without tokens."""
    bare = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""), F.lit(SPACES))
    return F.transform(F.split(F.nullif(bare, F.lit("")), SPACE_RUN), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, seed, at: one row per mask and window of the token hashes in ``t``.

    No filter is put on ``t``, and its positions are exploded as outer ones: a filter, also one that Spark infers
    below an explode, would make the tokens a second time.
    """
    n = F.size("t")
    at = rows.select(*keep, "t", n.alias("_n"), F.explode_outer(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("at"))
    each = []
    for k, mask in enumerate(MASKS):
        picked = [F.get("t", F.col("at") + p) for p, bit in enumerate(mask) if bit == "1"]
        each.append(F.when(F.col("at") <= F.col("_n") - len(mask), F.xxhash64(F.lit(k), *picked)))
    return at.select(*keep, F.explode(F.array(*each)).alias("seed"), "at").filter("seed IS NOT NULL")


def best_stretch(matches: str) -> str:
    """SQL of the stretch of a boolean array with the most matches less mismatches: (score, from, to, matched)."""
    start = ("named_struct('i', 0, 'cur', 0, 'cur_from', 0, 'cur_hits', 0, 'score', 0, 'first', 0, 'last', 0, 'hits', 0)")
    step = """(s, m) -> named_struct(
        'i', s.i + 1,
        'cur', greatest(s.cur + if(m, 1, -1), 0),
        'cur_from', if(s.cur + if(m, 1, -1) <= 0, s.i + 1, s.cur_from),
        'cur_hits', if(s.cur + if(m, 1, -1) <= 0, 0, s.cur_hits + if(m, 1, 0)),
        'score', greatest(s.score, s.cur + if(m, 1, -1)),
        'first', if(s.cur + if(m, 1, -1) > s.score, s.cur_from, s.first),
        'last', if(s.cur + if(m, 1, -1) > s.score, s.i + 1, s.last),
        'hits', if(s.cur + if(m, 1, -1) > s.score, s.cur_hits + if(m, 1, 0), s.hits))"""
    return f"aggregate({matches}, {start}, {step})"


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_from, item_from, n_tokens, n_matched, score of every contaminated pair."""
    # the items' tokens are used twice, and their number decides the join
    items = settled(items.select("item_id", token_hashes(F.col("text")).alias("t")))
    bench = seeds(items, ["item_id"]).select("item_id", "seed", F.col("at").alias("item_at")).distinct()
    n_seeds = (items.agg(F.sum(F.greatest(F.size("t"), F.lit(0)))).first()[0] or 0) * len(MASKS)
    if n_seeds <= BROADCAST_SEEDS:
        bench = F.broadcast(bench)
    hits = (seeds(docs.select("doc_id", token_hashes(F.col("text")).alias("t")), ["doc_id"]).join(bench, "seed")
            .select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    hits = settled(hits)

    # the texts with hits alone, compared along each diagonal over the item's length
    ids = hits.select(F.col("doc_id").alias("_id")).distinct().hint("shuffle_hash")
    wanted = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    wanted = wanted.select("doc_id", token_hashes(F.col("text")).alias("t"))
    pairs = hits.select(F.col("doc_id").alias("_id"), F.col("item_id").alias("_item"), "shift")
    sides = items.select("item_id", F.col("t").alias("item"))
    if n_seeds <= BROADCAST_SEEDS:
        sides = F.broadcast(sides)
    pairs = pairs.join(sides, F.col("_item").eqNullSafe(F.col("item_id")))
    both = wanted.join(pairs, F.col("doc_id").eqNullSafe(F.col("_id")))
    first = F.greatest(F.lit(0), -F.col("shift"))                    # of the item, where the document begins later
    both = both.withColumn("_from", first).select(
        "doc_id", "item_id", "shift", "_from", F.size("item").alias("_size"),
        F.expr("zip_with(slice(t, shift + _from + 1, greatest(0, least(size(item) - _from, size(t) - shift - _from))),"
               " slice(item, _from + 1, greatest(0, least(size(item) - _from, size(t) - shift - _from))), (a, b) -> a = b)").alias("_m"))
    both = both.filter(F.size("_m") >= MIN_SCORE).withColumn("_b", F.expr(best_stretch("_m")))
    enough = (F.col("_b.score") >= MIN_SCORE) & (F.col("_b.score") >= MIN_SHARE * F.least(F.col("_size"), F.lit(FULL)))
    item_from = F.col("_from") + F.col("_b.first")
    found = both.filter(enough).select("doc_id", "item_id", F.struct(
        F.col("_b.score").alias("score"), (-(F.col("shift") + item_from)).alias("o"), (-item_from).alias("i"),
        (F.col("_b.last") - F.col("_b.first")).alias("n"), F.col("_b.hits").alias("hits")).alias("_s"))
    best = found.groupBy("doc_id", "item_id").agg(F.max("_s").alias("_s"))   # the first of the best
    return best.select("doc_id", "item_id", (-F.col("_s.o")).cast("long").alias("doc_from"), (-F.col("_s.i")).cast("long").alias("item_from"),
                       F.col("_s.n").cast("long").alias("n_tokens"), F.col("_s.hits").cast("long").alias("n_matched"),
                       F.col("_s.score").cast("long").alias("score"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


_TOKENS = r"""list_filter(regexp_split_to_array(
    regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TOKENS} AS t FROM documents),
b AS (SELECT item_id, row_number() OVER () AS q, {_TOKENS} AS t FROM benchmark),
masks(k, span, ps) AS (VALUES (0, 5, [0, 2, 3, 4]), (1, 6, [0, 2, 3, 5]), (2, 6, [0, 1, 4, 5])),
dw AS (SELECT r, unnest(range(1, len(t) + 1)) AS a, t FROM d),
bw AS (SELECT q, unnest(range(1, len(t) + 1)) AS a, t FROM b),
ds AS (SELECT r, a, k, list_transform(ps, lambda p: t[a + p]) AS s FROM dw, masks WHERE a + span - 1 <= len(t)),
bs AS (SELECT q, a, k, list_transform(ps, lambda p: t[a + p]) AS s FROM bw, masks WHERE a + span - 1 <= len(t)),
hits AS (SELECT DISTINCT ds.r, q, ds.a - bs.a AS shift FROM ds JOIN bs USING (k, s)),
m AS (
  SELECT r, q, doc_id, item_id, shift, i, len(b.t) AS n, CASE WHEN d.t[shift + i] = b.t[i] THEN 1 ELSE 0 END AS hit
  FROM hits JOIN d USING (r) JOIN b USING (q), unnest(range(greatest(1, 1 - shift), least(len(b.t), len(d.t) - shift) + 1)) AS x(i)
), c AS (
  SELECT *, sum(hit) OVER w AS hits, sum(2 * hit - 1) OVER w AS score FROM m
  WINDOW w AS (PARTITION BY r, q, shift ORDER BY i ROWS UNBOUNDED PRECEDING)
), stretch AS (
  SELECT e.doc_id, e.item_id, e.shift, e.n, s.i - 1 AS item_from, e.i AS last, e.hits - s.hits + s.hit AS hits,
         e.score - s.score + 2 * s.hit - 1 AS score, e.r, e.q
  FROM c s JOIN c e ON e.r = s.r AND e.q = s.q AND e.shift = s.shift AND e.i >= s.i
), best AS (
  SELECT * FROM stretch
  QUALIFY row_number() OVER (PARTITION BY r, q, shift ORDER BY score DESC, last, item_from DESC) = 1
)
SELECT doc_id, item_id, shift + item_from AS doc_from, item_from, last - item_from AS n_tokens, hits::BIGINT AS n_matched,
       score::BIGINT AS score
FROM best WHERE score >= 7 AND score >= 0.4 * least(n, 32)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, shift + item_from, item_from, last DESC, hits DESC) = 1
"""
