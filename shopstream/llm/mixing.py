"""Mixing sources to target weights.

Every document gets a random key, the md5 of its id.  Within a source the documents are ranged by key:
key ranges are cut fine enough that each holds a bounded number of documents, range totals are summed
in key order, and only the one range that holds a source's cut is ordered document by document.
Whole rounds of a source are taken as often as its budget holds them, the rest is cut at the budget.
Documents are never truncated: the document on the cut is taken when that ends nearer to the target.

Defined results: null or blank text has size 0 and takes 0.  A null source comes after all others.
Documents with equal ids (also null ones) are ordered by size, then by the text's md5; rows
equal in all of these are taken or left together.  An empty table
gives an empty result.  Further input columns pass through; ``size``, ``source_size``, ``target``,
``copies`` and ``taken`` hold the operator's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, SPACE_RUN, salted_lookup, settled, table

WEIGHTS = (5, 2, 1)          # of the sources in code point order, repeating
SHARE = 1.5                  # of all words, shared among the sources
MAX_EPOCHS = 2               # a target stops at this many times its source
RANGE_DOCS = 2048            # documents a key range holds on average, at most
PREFIX_BITS = 28             # of the key, to cut ranges with
ADDED = ("size", "source_size", "target", "copies", "taken")


def text_size(text) -> F.Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")


def ordinals(keys: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Position of each distinct ``key`` (code point order, null last) by a range sort and per-range offsets."""
    placed = settled(keys.select(key).distinct()
                     .withColumn("_null", F.col(key).isNull())
                     .repartitionByRange(F.col("_null"), F.col(key))
                     .withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))     # one row per task
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy("_part").orderBy("_null", key)
    return (placed.join(F.broadcast(counts), "_part")
            .select(key, (F.col("_off") + F.row_number().over(inside) - 1).alias(ordinal)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, n_docs, target: weighted shares, each at most ``max_epochs`` times its source.

    What a source can't take is shared again by weight until no target is over its limit.  Each round is
    one aggregate over the sources; two sums reach the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = ordinals(sizes, "source", "_rank")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    rank = rank.withColumnRenamed("source", "_source")
    per = settled(per.join(rank, F.col("source").eqNullSafe(F.col("_source")))
                  .select("source", "source_size", "n_docs", weight.alias("_w"),
                          (F.col("source_size") * float(max_epochs)).alias("_cap")))
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    level, n_full = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("_cap") <= F.col("_w") * level
        got = per.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("cap"),
                      F.sum(F.when(full, 0.0).otherwise(F.col("_w"))).alias("w"),
                      F.sum(full.cast("int")).alias("n")).first()
        if not got["w"] or got["n"] == n_full:      # no source is left, or no further one reached its limit
            break
        level, n_full = (total - got["cap"]) / got["w"], got["n"]
    share_of = F.lit(0.0) if level is None else F.least(F.col("_cap"), F.col("_w") * level)
    return per.select("source", "source_size", "n_docs", share_of.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``docs`` with size, source_size, target, copies (times taken) and taken (words taken)."""
    keep = [c for c in docs.columns if c not in ADDED]
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    range_key = F.conv(F.substring(key, 1, PREFIX_BITS // 4), 16, 10).cast("long")
    tie = F.md5(F.coalesce(F.col("text"), F.lit("")))
    slim = settled(docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), tie.alias("_tie")))
    targets = settled(source_targets(slim, weights, share, max_epochs).withColumn(
        "rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
        .withColumn("ranges", F.ceil(F.col("n_docs") / RANGE_DOCS)))
    keyed = (salted_lookup(slim, targets.select("source", "ranges"), "source", F.col("doc_id"))
             .withColumn("_key", key)
             .withColumn("_range", F.shiftright(range_key * F.col("ranges"), PREFIX_BITS)))

    totals = keyed.groupBy("source", "_range").agg(F.sum("size").alias("_size"))
    ahead = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_size").over(ahead), F.lit(0)))
    budgets = targets.select(F.col("source").alias("_source"), "rest")
    cut = (totals.join(budgets, F.col("source").eqNullSafe(F.col("_source")))
           .filter((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_size") >= F.col("rest")))
           .select("_source", F.col("_range").alias("_cut"), "_before", "rest"))

    # the cut ranges alone, document by document; the last one taken is that whose half the budget reaches
    near = keyed.select("source", "_range", "_key", "doc_id", "size", "_tie").join(
        cut, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_cut")))
    order = W.partitionBy("_source").orderBy("_key", "doc_id", "size", "_tie").rowsBetween(W.unboundedPreceding, -1)
    reached = F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2
    near = near.withColumn("_taken", reached <= F.col("rest"))
    cuts = near.groupBy("_source", "_cut").agg(F.max(F.when(F.col("_taken"), F.struct("_key", "doc_id", "size", "_tie"))).alias("_end"))
    plan = targets.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left")
    plan = settled(plan.select("source", "source_size", "target", "rounds", "rest", "ranges", "_cut", "_end"))

    own = docs.select(*keep, text_size(F.col("text")).alias("size"), key.alias("_key"), range_key.alias("_rk"), tie.alias("_tie"))
    own = salted_lookup(own, plan, "source", F.col("doc_id"))
    here = F.shiftright(F.col("_rk") * F.col("ranges"), PREFIX_BITS)
    inside = (here < F.col("_cut")) | (
        (here == F.col("_cut")) & (F.struct("_key", "doc_id", "size", "_tie") <= F.col("_end")))
    copies = F.col("rounds") + F.when((F.col("rest") > 0) & F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    return own.select(*keep, "size", "source_size", "target", copies.cast("long").alias("copies"),
                      (copies * F.col("size")).cast("long").alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k, md5(coalesce(text, '')) AS tie
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM per
), levels AS (  -- sources by the level at which they are full; the first level that fills no further source holds
  SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT (total - cap_before) / w_left AS level FROM levels
  WHERE cap > w * ((total - cap_before) / w_left) ORDER BY cap / w, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, least(cap, w * level) AS target FROM w, level
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rounds FROM t
), a AS (
  SELECT doc_id, size, source_size, target, rounds, target - rounds * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size, tie
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       (size * (rounds + CASE WHEN rest > 0 AND ahead + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM a
"""
