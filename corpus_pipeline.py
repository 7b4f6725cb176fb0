"""A corpus pipeline: language, quality, near duplicates, benchmark passages, mixing.

Each stage takes what its predecessor kept and returns documents (doc_id, text, lang, source, n_chars);
the last one returns a row for each time a document is taken, with ``epoch``, its ``size`` in words and
its source's ``target``.  Stages don't share state: every result is written as Parquet to the session's
checkpoint folder and read again, so that a lost executor costs the tasks it ran and nothing else.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstream.llm import decontaminate, language_id, mixing, ngram_join, quality
from shopstream.llm.common import table
from shopstream.session import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_N, NEAR_PERCENT = 5, 80         # words of a shingle, similarity in percent


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the source stands for the host, ``lang`` for the declaration."""
    model = language_id.train(docs)
    source = F.col("source")
    found = language_id.identified(docs, model, "text", F.col("lang"), source, language_id.suffix_of(source))
    return found.filter(~F.col("rejected")).select(*COLUMNS)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of label 1."""
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.quality_scores(docs, model).filter("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs, NEAR_N, NEAR_PERCENT).select(*COLUMNS)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    # rows are told apart by id and text: a bad text doesn't take others of its id (or without one) along
    row = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.select(row.alias("doc_id"), "text")
    found = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark", "item_id", "text"))
    bad = found.select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, row == F.col("_bad"), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each time a document is taken."""
    mixed = mixing.mix(docs).filter("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("epoch"), "size", "target")


STAGES = [
    ("language_id", identify_language),
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
]

ORACLE_SQL = None                    # trained models and n-gram hashing aren't expressible


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
