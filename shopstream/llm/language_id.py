"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per row: the text's likelihood under byte n-gram models of
each language, the declared language (markup or metadata), the address suffix, and the host.  Hosts'
priors are smoothed hierarchically: a host's soft counts are topped up by ``STRENGTH`` rows of its
suffix's distribution, which in turn is topped up from all rows.  Counts come from grouped aggregation of
the texts' own posteriors over all rows; a row's own part is taken out of its host's count.  How far a
declaration is believed follows from how often declarations and texts agree, over all rows.

The n-gram models are trained on all rows with a declared language, one pass of bounded partial counts
(``FEATURES`` slots per language).  A further model, uniform over the slots, stands for text in no known
language; where it wins, or where a text has no letters at all, the language is ``und`` and the row is
rejected.

Defined results: null and empty texts are ``und``.  A null or unknown declaration is a kind of its own; a
null host has the empty host's counts.  Repeated rows count as often as they occur.  Without training
rows every row is ``und``.  Further columns pass through; ``lang_id``, ``confidence`` and ``rejected``
hold the operator's values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_lookup, table
from .main_text import main_text

BITS = 15
FEATURES = 1 << BITS
GRAMS = (1, 2, 3)            # bytes of an n-gram, of lower-cased letters with single spaces around words
TEMPER = 1 / len(GRAMS)      # overlapping n-grams aren't independent
SMOOTHING = 0.1
STRENGTH = 20.0              # rows that a parent's distribution is worth
UNKNOWN = 1e-4               # prior of text in no known language
LANGUAGES = 256              # a model has the languages that most rows declare; a rarer tag counts as no declaration

# bytes that are letters: lower-cased ASCII letters and all bytes of other characters; the rest are spaces
_LETTER = np.full(256, 32, np.uint8)
_LETTER[128:] = np.arange(128, 256)
_LETTER[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def slots(text: bytes) -> np.ndarray:
    """The hashed n-grams of a text's letters, in no order, with repetition."""
    raw = _LETTER[np.frombuffer(text, np.uint8)]
    raw = np.concatenate(([32], raw, [32])).astype(np.uint32)
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    raw = raw[keep]
    if len(raw) < 3:
        return np.empty(0, np.uint32)
    out = []
    for n in GRAMS:
        code = np.full(len(raw) - n + 1, n, np.uint32)
        for k in range(n):
            code = (code << np.uint32(8)) | raw[k:len(raw) - n + 1 + k]
        out.append((code * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    return np.concatenate(out)


def texts_of(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary()).to_pylist()


class TextModel:
    """Log probabilities of the slots per language; the last row is the uniform one."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        p = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * FEATURES)
        self.logs = np.log(np.vstack([p, np.full((1, FEATURES), 1 / FEATURES)])).astype(np.float32)

    def likelihoods(self, text: bytes) -> np.ndarray | None:
        """Tempered log likelihood of the text under each model; None without letters."""
        found = slots(text)
        if not len(found):
            return None
        seen = np.bincount(found, minlength=FEATURES)
        at = np.flatnonzero(seen)
        return TEMPER * (self.logs[:, at].astype(float) @ seen[at])


def train(docs: DataFrame, text: str = "text", declared: str = "lang") -> TextModel:
    """Slot counts of the ``LANGUAGES`` languages declared most often (ties: by name), over all rows that declare them."""
    rows = docs.select(F.col(text).alias("text"), F.lower(F.regexp_extract(F.trim(declared), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1)).alias("lang"))
    rows = rows.filter("lang != ''")
    known = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    rows = rows.filter(F.col("lang").isin([r["lang"] for r in known]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(texts_of(batch.column("text")), batch.column("lang").to_pylist()):
                if lang not in told:
                    told[lang] = np.zeros(FEATURES, np.int64)
                told[lang] += np.bincount(slots(text), minlength=FEATURES)
        for lang, counts in told.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(at), pa.string()), "slot": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})

    # at most LANGUAGES x FEATURES sums, gathered per language
    sums = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    got = sums.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("ns")).orderBy("lang").collect()
    counts = np.zeros((len(got), FEATURES))
    for i, r in enumerate(got):
        counts[i][r["slots"]] = r["ns"]
    return TextModel([r["lang"] for r in got], counts)


def identified(rows: DataFrame, model: TextModel, text: str, declared: Column, host: Column, suffix: Column,
               prepare: Callable[[str], str] | None = None) -> DataFrame:
    """``rows`` with lang_id, confidence (posterior) and rejected.  ``prepare`` takes the text from the column, in the task."""
    keep = [c for c in rows.columns if c not in {"lang_id", "confidence", "rejected"}]
    names = model.languages
    n = len(names)

    @F.pandas_udf("array<double>")
    def likelihoods(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for x in batch:
                told = model.likelihoods(((prepare(x) if prepare else x) or "").encode()) if x is not None and n else None
                out.append(None if told is None else (told - told.max()).tolist())
            yield pd.Series(out, dtype=object)

    tag = F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    kind = F.when(tag.isin(*names), tag).otherwise(F.lit("")) if n else F.lit("")
    told = rows.select(*keep, likelihoods(F.col(text)).alias("_ll"), kind.alias("_kind"),
                       F.coalesce(host, F.lit("")).alias("_host"), F.coalesce(suffix, F.lit("")).alias("_suffix"))
    if not n:
        return told.select(*keep, F.lit("und").alias("lang_id"), F.lit(0.0).alias("confidence"), F.lit(True).alias("rejected"))

    # what the texts alone say, with equal priors
    weights = [F.exp(F.get("_ll", F.lit(i))) for i in range(n)] + [UNKNOWN * F.exp(F.get("_ll", F.lit(n)))]
    total = sum(weights[1:], weights[0])
    told = told.select("*", *[F.coalesce(w / total, F.lit(0.0)).alias(f"_p{i}") for i, w in enumerate(weights[:n])])
    ps = [f"_p{i}" for i in range(n)]
    per_host = told.groupBy("_suffix", "_host", "_kind").agg(*[F.sum(p).alias(p) for p in ps])
    # agreement of declarations and texts: one row per kind, known languages and ""
    agree = {r["_kind"]: [r[p] for p in ps] for r in per_host.groupBy("_kind").agg(*[F.sum(p).alias(p) for p in ps]).collect()}
    kinds = [*names, ""]
    joint = np.array([agree.get(k, [0.0] * n) for k in kinds]) + 1.0
    believed = np.log(joint / joint.sum(0))                          # P(kind | language)
    overall = joint.sum(0) / joint.sum()
    by_suffix = per_host.groupBy("_suffix").agg(*[F.sum(p).alias(f"s{i}") for i, p in enumerate(ps)])
    of_suffix = sum((F.col(f"s{i}") for i in range(1, n)), F.col("s0"))
    by_suffix = by_suffix.select(F.col("_suffix").alias("_of"), *[
        ((F.col(f"s{i}") + STRENGTH * float(overall[i])) / (of_suffix + STRENGTH)).alias(f"_s{i}") for i in range(n)])
    hosts = per_host.groupBy("_suffix", "_host").agg(*[F.sum(p).alias(f"_h{i}") for i, p in enumerate(ps)])
    hosts = hosts.join(by_suffix, F.col("_suffix") == F.col("_of")).select(
        F.struct("_suffix", "_host").alias("_at"), *[f"_h{i}" for i in range(n)], *[f"_s{i}" for i in range(n)])

    out = salted_lookup(told.withColumn("_at", F.struct("_suffix", "_host")), hosts, "_at", F.xxhash64(*[F.col(c) for c in keep[:1]], "_ll"))
    own = [F.greatest(F.lit(0.0), F.col(f"_h{i}") - F.col(f"_p{i}")) for i in range(n)]
    of_host = sum(own[1:], own[0]) + STRENGTH
    scores = []
    for i in range(n):
        prior = F.log((own[i] + STRENGTH * F.col(f"_s{i}")) / of_host)
        said = F.element_at(F.create_map(*[x for k, name in enumerate(kinds) for x in (F.lit(name), F.lit(float(believed[k][i])))]), F.col("_kind"))
        scores.append(F.get("_ll", F.lit(i)) + prior + said)
    scores.append(F.get("_ll", F.lit(n)) + math.log(UNKNOWN) - math.log(len(kinds)))
    out = out.select(*keep, F.array(*scores).alias("_scores"))
    best = F.array_max("_scores")
    at = F.array_position("_scores", best) - 1                       # of equal scores the first language
    out = out.select(*keep, F.when(F.get("_scores", F.lit(0)).isNull(), F.lit("und")).otherwise(
        F.get(F.array(*[F.lit(x) for x in [*names, "und"]]), at.cast("int"))).alias("lang_id"),
        F.coalesce(1 / F.aggregate("_scores", F.lit(0.0), lambda s, x: s + F.exp(x - best)), F.lit(0.0)).alias("confidence"))
    return out.select(*keep, "lang_id", "confidence", (F.col("lang_id") == "und").alias("rejected"))


def suffix_of(host: Column) -> Column:
    """The last name of a host."""
    return F.substring_index(host, ".", -1)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: models from all documents, evidence from markup, address and host of the pages."""
    from .url_filter import url_parts
    model = train(table(spark, sf_dir, "documents", "text", "lang"))
    host, _ = url_parts(F.col("url"))
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html").withColumn("host", host)
    declared = F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    out = identified(pages, model, "html", declared, F.col("host"), suffix_of(F.col("host")), main_text)
    return out.select("page_id", "url", "host", "lang_id", "confidence", "rejected")
