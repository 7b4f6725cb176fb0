"""Quality classifier: naive Bayes support vectors.

Features are indicators of byte n-grams of the whole text, hashed into ``FEATURES`` slots.  Each is
scaled by its class log-count ratio; a linear model with hinge loss is fitted to the scaled, length
normalised indicators by dual coordinate descent, and blended with the plain ratios (interpolation).
A logistic curve fitted on labelled rows that the linear model hasn't seen turns margins into scores.

The model is fitted on a bounded sample of labelled rows: the ``SAMPLE`` rows with the least id hashes
among those of the training folds.  Scoring covers all rows, whole texts, without a shuffle; the
weights (``FEATURES`` numbers, a fixed size) go with the tasks.

Defined results: null and empty texts have no features and get the score of the model's offset.
Unlabelled rows, null labels and ids without a document are no training rows; an id labelled more than
once counts with the least label; an id with several texts counts with each.  Without training rows of
both classes every score is the share of label 1 (0.5 without any label).  Further columns pass through;
``held_out``, ``score`` and ``predicted`` hold the operator's values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .word_arrays import U, mix

BITS = 17
FEATURES = 1 << BITS
GRAMS = (1, 2, 3)            # bytes of an n-gram
SAMPLE = 10_000              # labelled rows the model is fitted on, at most
CALIBRATION = 5              # every fifth of them fits the logistic curve
THRESHOLD = 0.3
HELD_OUT_FOLD = 0
COST, EPOCHS, BLEND, SMOOTHING = 1.0, 12, 0.25, 1.0


def features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """The slots of a text's n-grams, ascending; ``seen`` is a scratch array of FEATURES falses."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    for n in GRAMS:
        if len(raw) < n:
            break
        code = np.full(len(raw) - n + 1, n, np.uint32)
        for k in range(n):
            code = (code << np.uint32(8)) | raw[k:len(raw) - n + 1 + k]
        seen[(code * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def texts_of(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary()).to_pylist()


@dataclass
class Model:
    weights: np.ndarray          # of an indicator, ratio and linear weight multiplied
    scale: np.ndarray            # squared log-count ratios, for the length of a text's vector
    offset: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.offset
        return float(self.weights[found].sum() / np.sqrt(self.scale[found].sum() + 1e-12) + self.offset)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model (weights, offset) by coordinate descent in the dual; rows in a fixed random order."""
    w, b = np.zeros(FEATURES), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.RandomState(7)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (float(w[rows[i]] @ values[i]) + b) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), costs[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                w[rows[i]] += step * values[i]
                b += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's curve, by Newton steps on smoothed targets."""
    pos, neg = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p) - 1e-6 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, calibration: np.ndarray) -> Model:
    """The model of feature rows with 0/1 labels; rows of ``calibration`` fit the logistic curve only."""
    learn = [i for i in range(len(rows)) if not calibration[i]]
    y = labels[learn]
    if not len(y) or y.min() == y.max():
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = np.zeros((2, FEATURES))
    for i in learn:
        counts[int(labels[i])][rows[i]] += 1
    counts += SMOOTHING
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = []
    for i in learn:
        v = ratio[rows[i]]
        values.append(v / np.sqrt(v @ v + 1e-12))
    costs = np.where(y > 0, COST * len(y) / (2 * y.sum()), COST * len(y) / (2 * (len(y) - y.sum())))
    w, b = dual_descent([rows[i] for i in learn], values, 2.0 * y - 1, costs)
    w = (1 - BLEND) * np.abs(w).mean() + BLEND * w
    model = Model(w * ratio, ratio * ratio, b, 1.0, 0.0)
    check = [i for i in range(len(rows)) if calibration[i]] or learn
    if labels[check].min() == labels[check].max():
        check = learn
    model.slope, model.shift = logistic(np.array([model.margin(rows[i]) for i in check]), labels[check])
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model fitted on the bounded sample, in one task; only the finished weights reach the driver."""
    sample = (labels.filter((fold(F.col("doc_id")) != HELD_OUT_FOLD) & F.col("quality").isin(0, 1))
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    sample = sample.withColumnRenamed("doc_id", "_id")
    # at most SAMPLE rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select(
        "doc_id", "quality", F.col("text"))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FEATURES, bool)
        for batch in batches:
            found = [features(t, seen).astype(np.uint32).tobytes() for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "found": pa.array(found, pa.binary())})

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, found = [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            labels += batch.column("quality").to_pylist()
            found += [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column("found")]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], found[i].tobytes()))
        calibration = mix(np.array([ids[i] for i in order], np.int64).view(U)) % U(CALIBRATION) == 0
        model = fit([found[i] for i in order], np.array([labels[i] for i in order], float), calibration)
        yield pa.RecordBatch.from_pydict({
            "weights": pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()),
            "scale": pa.array([model.scale.astype(np.float32).tobytes()], pa.binary()),
            "numbers": pa.array([[model.offset, model.slope, model.shift]], pa.list_(pa.float64()))})

    found = rows.mapInArrow(rows_of, "doc_id long, quality int, found binary")
    got = found.repartition(1).mapInArrow(fitted, "weights binary, scale binary, numbers array<double>").first()
    return Model(np.frombuffer(bytes(got["weights"]), np.float32).astype(float),
                 np.frombuffer(bytes(got["scale"]), np.float32).astype(float), *got["numbers"])


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with held_out, score (that the label is 1) and predicted; scoring needs the text only."""
    keep = [c for c in docs.columns if c not in {"held_out", "score", "predicted"}]

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = np.zeros(FEATURES, bool)
        for batch in batches:
            yield pd.Series([model.score(features((t or "").encode(), seen)) for t in batch], dtype=float)

    out = docs.select(*keep, scores(F.coalesce("text", F.lit(""))).alias("score"))
    return out.select(*keep, (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_scores(docs, model).select("doc_id", "held_out", "score", "predicted")
