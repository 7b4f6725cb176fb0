"""Host-level quality rules.

Every document is measured by whole-text rules.  Failures are counted per host and rule, each rate is
shrunk towards the rule's mean with a beta prior fitted to all hosts, and a host whose shrunk rate
passes the rule's limit is rejected; its verdict is joined back to its documents.

Defined results: null or blank text has no words, so it fails ``base_failed``.  Documents without a
host form one host of their own.  Repeated rows count as often as they occur.  An empty table gives
an empty result.  Other columns of the input pass through untouched unless their name is one of the
result's, which then holds the operator's value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, salted_lookup, settled, table, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_SHARE = 0.5
WINDOW = 3

# A host is rejected when its shrunk failure rate of a rule is over the rule's limit.
HOST_LIMITS = {"base": 0.6, "symbols": 0.6, "dup_lines": 0.6, "word_length": 0.6}
MIN_GAMMA, MAX_GAMMA = 1e-6, 0.999999

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus the measures of each whole text; no shuffle.

    Windows are compared by their 64-bit hash: sorting (hash, position) brings equal windows together,
    so a text of n words costs n log n, however long it is.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(
        *keep,
        words(F.col("text")).alias("_w"),
        F.length(F.regexp_replace(text, SPACE_RUN, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(" \t\x0b\x0c\r"))) > 0).alias("_lines"),
    )
    step = step.select(
        *keep, "word_chars", "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= WINDOW, F.expr(
            f"sort_array(transform(sequence(0, size(_w) - {WINDOW}), i -> struct(xxhash64("
            + ", ".join(f"get(_w, i + {k})" for k in range(WINDOW)) + ") as h, i as i)))")).alias("_s"),
    )
    step = step.select(
        *keep, *MEASURES[:4],
        F.expr("sort_array(transform(filter(_s, (x, k) -> get(_s, k - 1).h = x.h or get(_s, k + 1).h = x.h), "
               "x -> x.i))").alias("_p"),
    )
    covered = (f"aggregate(zip_with(_p, slice(_p, 2, greatest(size(_p), 1)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), "
               "0L, (t, x) -> t + x)")
    return step.select(*keep, *MEASURES[:4], F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED_SHARE) * n)


def rule_failures() -> dict[str, Column]:
    """Which rules a document fails, from its measures."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "base": base_failed(),
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 100 * F.col("n_dup_lines") > 10 * n,
        "word_length": (chars < 2 * n) | (chars > 15 * n),
    }


def host_verdicts(failures: DataFrame, host: str, rules: list[str]) -> DataFrame:
    """Per host: documents, and for each rule its failures and shrunk rate; ``rejected`` if any rate is too high.

    The beta prior of a rule comes from the moments of the hosts' rates (beta-binomial, Kleinman's
    estimate): ``gamma`` = 1 / (alpha + beta + 1).  All sums are partial aggregates; the prior is one row.
    """
    per_host = failures.groupBy(host).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(f"k_{r}") for r in rules])
    sums = [F.count(F.lit(1)).alias("h"), F.sum("n").alias("t"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("nn")]
    for r in rules:
        k = F.col(f"k_{r}")
        sums += [F.sum(k).alias(f"t_{r}"), F.sum((k * k).cast("double") / F.col("n")).alias(f"kk_{r}")]
    prior = per_host.agg(*sums)
    h, t, nn = F.col("h"), F.col("t").cast("double"), F.col("nn")
    fitted = []
    for r in rules:
        mean = F.col(f"t_{r}") / t
        spread = F.col(f"kk_{r}") - mean * F.col(f"t_{r}")           # sum of n (rate - mean)^2
        noise = mean * (1 - mean)
        gamma = (spread - noise * (h - 1)) / (noise * (t - nn / t - (h - 1)))
        gamma = F.when((noise > 0) & (t - nn / t - (h - 1) > 0), gamma).otherwise(F.lit(MIN_GAMMA))
        fitted += [mean.alias(f"mean_{r}"), F.greatest(F.lit(MIN_GAMMA), F.least(F.lit(MAX_GAMMA), gamma)).alias(f"gamma_{r}")]
    prior = prior.filter(F.col("h") > 0).select(*fitted)
    joined = per_host.join(F.broadcast(prior.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).drop("_one")  # one row
    out, bad = [F.col(host), F.col("n")], F.lit(False)
    for r in rules:
        weight = 1 / F.col(f"gamma_{r}") - 1                          # alpha + beta
        rate = (F.col(f"k_{r}") + F.col(f"mean_{r}") * weight) / (F.col("n") + weight)
        out += [F.col(f"k_{r}"), rate.alias(f"rate_{r}")]
        bad = bad | (rate > F.lit(HOST_LIMITS[r]))
    return joined.select(*out, bad.alias("host_rejected"))


def host_level_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """Measures and verdict of each document: kept unless it or its host fails."""
    rules = list(HOST_LIMITS)
    keep = [c for c in docs.columns if c not in {"text", "base_failed", "host_rejected", "kept", *MEASURES}]
    slim = measured(docs, keep)
    slim = settled(slim.select(*keep, *MEASURES, *[c.alias(f"fails_{r}") for r, c in rule_failures().items()]))
    hosts = host_verdicts(slim, host, rules).select(host, "host_rejected")
    out = salted_lookup(slim, hosts, host, F.struct(*[slim[c] for c in MEASURES]))
    return out.select(*keep, *MEASURES, F.col("fails_base").alias("base_failed"), "host_rejected",
                      (~F.col("fails_base") & ~F.col("host_rejected")).alias("kept"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return host_level_rules(docs).select("doc_id", *MEASURES, "base_failed", "kept", "host_rejected")


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), v AS (
  SELECT *, row_number() OVER () AS id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM w
), windows AS (
  SELECT id, unnest(range(1, len(w) - 1)) AS i, w FROM v WHERE len(w) >= 3
), told AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, w[i], w[i + 1], w[i + 2]) AS n FROM windows
), hit AS (
  SELECT id, count(DISTINCT i + d)::BIGINT AS n_repeat_words
  FROM told, (VALUES (0), (1), (2)) AS x(d) WHERE n > 1 GROUP BY id
), m AS (
  SELECT doc_id, source, n_words, word_chars, n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM v LEFT JOIN hit USING (id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS f_base, 10 * n_symbols > n_words AS f_symbols,
         100 * n_dup_lines > 10 * n_words AS f_dup_lines,
         word_chars < 2 * n_words OR word_chars > 15 * n_words AS f_word_length
  FROM m
), long AS (
  SELECT source, 'base' AS r, f_base AS x FROM f UNION ALL SELECT source, 'symbols', f_symbols FROM f
  UNION ALL SELECT source, 'dup_lines', f_dup_lines FROM f UNION ALL SELECT source, 'word_length', f_word_length FROM f
), per AS (
  SELECT source, r, count(*)::DOUBLE AS n, sum(x::INT)::DOUBLE AS k FROM long GROUP BY source, r
), s AS (
  SELECT r, count(*) AS h, sum(n) AS t, sum(n * n) AS nn, sum(k) AS tk, sum(k * k / n) AS kk FROM per GROUP BY r
), p AS (
  SELECT r, tk / t AS mean, greatest(1e-6, least(0.999999, CASE
    WHEN tk / t * (1 - tk / t) > 0 AND t - nn / t - (h - 1) > 0
    THEN (kk - tk / t * tk - tk / t * (1 - tk / t) * (h - 1)) / (tk / t * (1 - tk / t) * (t - nn / t - (h - 1)))
    ELSE 1e-6 END)) AS gamma FROM s
), hosts AS (
  SELECT source, bool_or((k + mean * (1 / gamma - 1)) / (n + (1 / gamma - 1)) > 0.6) AS host_rejected
  FROM per JOIN p USING (r) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_base AS base_failed,
       NOT f_base AND NOT host_rejected AS kept, host_rejected
FROM f JOIN hosts ON f.source IS NOT DISTINCT FROM hosts.source
"""
