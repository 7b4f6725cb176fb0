"""URL filter: host word segmentation and naive Bayes, under explicit rules.

A host's names are split into words by the most probable sequence under a unigram model (Viterbi), the
unigrams being counted in the pages' own text.  A multinomial naive Bayes model scores the words of the
host and the tokens of the path, as often as they occur.  It learns from weak labels: pages that a rule
judges, and pages whose host holds a seed word (always a block).  Each host counts once per class and
token in learning, so that one host with a third of all pages doesn't set the weights.  What the rules
look at is no feature: neither the tokens they are made of, nor the leading path segments they compare,
whose other values (further languages, say) would count as blocked only for not being in an allow rule.
An explicit rule's verdict always stands; other urls are blocked when their host holds a seed
word or the model's posterior is over ``BLOCK_POSTERIOR``, with equal class priors.

Defined results: a null url, or one without ``://``, has empty host and path and, without any token, the
verdict allow.  Of rules of equal length the first listed wins.  Repeated rows are judged each; an empty
table gives an empty result.  Further columns pass through unless named like a result column.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_lookup, settled, table

# (verdict, host/path): fits the host and all its subdomains where the path starts alike.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Host words that mark a page as unwanted for training.
SEED_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "xxx")
BLOCK_POSTERIOR = 0.9
SMOOTHING = 1.0
LONGEST_WORD = 20            # letters; longer host words are split
COUNTER_WORDS = 200_000      # words a task gathers before it passes their counts on

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def rule_tokens(rules=RULES) -> list[str]:
    return sorted({t for _, r in rules for t in re.split(r"[^a-z0-9]+", r.lower()) if t})


def without(tokens: Column, words: list[str]) -> Column:
    """An array without these words; others keep their repeats."""
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def path_tokens(path: Column, rules=RULES) -> Column:
    """The path's tokens, each as often as it occurs, behind the segments that the rules compare."""
    depth = max((len([s for s in r.split("/")[1:] if s]) for _, r in rules), default=0)
    rest = F.regexp_replace(path, rf"^(/[^/]*){{0,{depth}}}", "") if depth else path
    return without(F.regexp_extract_all(F.translate(rest, UPPER, LOWER), F.lit(r"([a-z0-9]*[a-z][a-z0-9]*)")), rule_tokens(rules))


def unigrams(texts: DataFrame, column: str) -> DataFrame:
    """word, n: letter runs of the column outside of markup.  Tasks pass on bounded partial counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: Counter[str] = Counter()
        for batch in batches:
            for text in batch[column]:
                if text:
                    told.update(re.findall(r"[a-z]+", re.sub(r"<[^>]*>", " ", text.lower())))
                if len(told) >= COUNTER_WORDS:
                    yield pd.DataFrame({"word": list(told.keys()), "n": list(told.values())})
                    told.clear()
        if told:
            yield pd.DataFrame({"word": list(told.keys()), "n": list(told.values())})

    found = texts.select(column).mapInPandas(count, "word string, n long")
    return found.filter(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.sum("n").alias("n"))


def split_name(name: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """The most probable words of a name; ``known``: counts of its substrings by (start, end).

    An unknown word of k letters has the probability 10 / (total * 10^k).  Of equally probable
    splittings that with the longer last word is taken.
    """
    best, back = [0.0], [0]
    log_total = math.log(total)
    for end in range(1, len(name) + 1):
        score, where = -math.inf, 0
        for start in range(max(0, end - LONGEST_WORD), end):
            n = known.get((start, end))
            here = best[start] + (math.log(n) if n else math.log(10) * (1 - (end - start))) - log_total
            if here > score:
                score, where = here, start
        best.append(score)
        back.append(where)
    out, end = [], len(name)
    while end:
        out.append(name[back[end]:end])
        end = back[end]
    return out[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """name, words: names (distinct, of letters) split by unigram Viterbi.

    Only the substrings of the names meet the word counts, in a join; the matches of one name are
    bounded by its length.
    """
    pieces = names.select("name", F.explode(F.sequence(F.lit(0), F.length("name") - 1)).alias("at"))
    pieces = pieces.select("name", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("name") - F.col("at")))).alias("len"))
    pieces = pieces.withColumn("word", F.substring("name", F.col("at") + 1, F.col("len")))
    matches = (pieces.join(counts, "word").groupBy("name")
               .agg(F.collect_list(F.struct("at", "len", "n")).alias("known")))
    total = max(1, counts.agg(F.sum("n")).first()[0] or 0)

    @F.pandas_udf("array<string>")
    def viterbi(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([split_name(x, {(m["at"], m["at"] + m["len"]): m["n"] for m in (k if k is not None else ())}, total)
                          for x, k in zip(name, known)], dtype=object)

    return names.join(matches, "name", "left").select("name", viterbi("name", "known").alias("words"))


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host, words: the words of each (distinct) host in alphabetical order, each as often as it occurs."""
    named = hosts.select("host", F.explode(F.regexp_extract_all("host", F.lit(r"([a-z]+)"))).alias("name"))
    split = segmented(named.select("name").distinct(), counts)
    return (named.join(split, "name").select("host", F.explode("words").alias("word"))
            .groupBy("host").agg(F.sort_array(F.collect_list("word")).alias("words")))     # bounded by the host's length


def judged(pages: DataFrame, counts: DataFrame, rules=RULES, seeds=SEED_WORDS) -> DataFrame:
    """``pages`` with host, path, rule, verdict, host_words, log_odds (of block) and by_rule."""
    added = {"host", "path", "rule", "verdict", "host_words", "log_odds", "by_rule"}
    keep = [c for c in pages.columns if c not in added]
    host, path = url_parts(F.col("url"))
    parsed = pages.select(*keep, host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    tokens = path_tokens(F.col("path"), rules)
    parsed = settled(parsed.select(*keep, "host", "path", rule.alias("rule"), said.alias("_said"),
                                   F.array_join(F.sort_array(tokens), " ").alias("_tokens")))

    words = settled(host_words(parsed.select("host").distinct(), counts))
    words = words.withColumn("words", without(F.col("words"), rule_tokens(rules)))
    seeded = words.select("host", F.arrays_overlap("words", F.array(*[F.lit(s) for s in seeds])).alias("seeded"))

    # weak labels: each (host, class, token) once
    by_host = parsed.groupBy("host", "_said", "_tokens").agg(F.count(F.lit(1)).alias("n"))
    labelled = by_host.join(seeded, "host", "left").select(
        "host", F.when(F.col("seeded"), F.lit("block")).otherwise(F.col("_said")).alias("class"), "_tokens")
    labelled = labelled.filter(F.col("class").isNotNull())
    classes = labelled.select("host", "class").distinct()
    of_host = classes.join(words, "host").select("class", "host", F.explode(F.array_distinct("words")).alias("token"))
    of_path = labelled.select("class", "host", F.explode(F.split("_tokens", " ")).alias("token")).filter("token != ''").distinct()
    seen = of_host.unionByName(of_path).distinct()
    is_block = (F.col("class") == "block").cast("long")
    weights = seen.groupBy("token").agg(F.sum(is_block).alias("b"), F.sum(1 - is_block).alias("a"))
    sums = weights.agg(F.sum("b"), F.sum("a"), F.count(F.lit(1))).first()       # three numbers
    b, a, v = (sums[0] or 0), (sums[1] or 0), sums[2]
    odds = (F.log((F.col("b") + SMOOTHING) / F.lit(b + SMOOTHING * (v + 1)))
            - F.log((F.col("a") + SMOOTHING) / F.lit(a + SMOOTHING * (v + 1))))
    weights = settled(weights.select("token", odds.alias("w")))

    host_odds = (words.select("host", F.explode_outer("words").alias("token")).join(weights, "token", "left")
                 .groupBy("host").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("_of_host"))
                 .join(words, "host").join(seeded, "host"))
    path_odds = (parsed.select("_tokens").distinct().filter("_tokens != ''")
                 .select("_tokens", F.explode(F.split("_tokens", " ")).alias("token")).join(weights, "token")
                 .groupBy("_tokens").agg(F.sum("w").alias("_of_path")))
    out = salted_lookup(parsed, host_odds, "host", F.col("path"))
    out = salted_lookup(out, path_odds, "_tokens", F.struct("host", "path"))
    score = F.round(F.coalesce("_of_host", F.lit(0.0)) + F.coalesce("_of_path", F.lit(0.0)), 9)
    limit = math.log(BLOCK_POSTERIOR / (1 - BLOCK_POSTERIOR))
    return out.select(
        *keep, "host", "path", "rule",
        F.coalesce("_said", F.when(F.coalesce("seeded", F.lit(False)) | (score > limit), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("words", F.array().cast("array<string>")).alias("host_words"),
        score.alias("log_odds"), F.col("_said").isNotNull().alias("by_rule"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = settled(unigrams(table(spark, sf_dir, "pages", "html"), "html"))
    return judged(table(spark, sf_dir, "pages", "page_id", "url"), counts).drop("url")
