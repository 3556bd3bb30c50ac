"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text is lower-cased; its character n-grams (n in `orders`) are hashed into `dims` features, present or absent. A
feature's scale is the log ratio of its smoothed document frequencies among toxic and other training texts; a logistic
regression with an L2 penalty, which shrinks what the labels don't tell apart, is fitted on all scaled features.

Fitting takes at most `max_rows` labelled texts (a documented bound, chosen by a hash of the id, the same at every
corpus size) in one task; the model is `dims` numbers. Scoring takes every text, whole, without a shuffle.

Nulls: a null text scores as an empty one: the model's bias. A null doc_id is kept and scored; labels that are null, or
without a document, aren't learned from; of several labels of an id the largest counts. Repeated rows are scored each.
Without any training rows, or with one class only, every score is the rate of label 1 (0 without rows). Extra columns
are ignored by scores and pass through `score`; the columns it adds replace columns of the same name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import crc_mod, lean, materialize, read

DIMS = 1 << 18
ORDERS = (3, 4, 5)
MAX_ROWS = 6_000
SMOOTH = 1.0
PENALTY = 3e-3  # of four settings the least log loss, over two folds of the learnable rows of sf0.1
STEPS = 60
#: Rows whose terms are summed at once while fitting.
BLOCK = 256


def features(text: str | None, dims: int = DIMS, orders: tuple = ORDERS) -> np.ndarray:
    """Sorted distinct feature numbers of a text, bounded by a line feed on either side."""
    if not text:
        return np.empty(0, np.int32)
    c = np.frombuffer(f"\n{text.lower()}\n".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found, h = [], c
    for n in range(1, max(orders) + 1):
        if n > 1:
            if len(c) < n:
                break
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
        if n in orders:
            m = h * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)
            found.append(((m ^ (m >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(40)).astype(np.uint32) % np.uint32(dims))
    if not found:
        return np.empty(0, np.int32)
    x = np.sort(np.concatenate(found))
    return x[np.concatenate(([True], x[1:] != x[:-1]))].astype(np.int32)


def fit(texts: list[str | None], labels: np.ndarray, dims: int = DIMS, orders: tuple = ORDERS, smooth: float = SMOOTH, penalty: float = PENALTY, steps: int = STEPS) -> dict:
    """The weight of each feature (scale times coefficient) and the bias. Features are made twice, first to be counted,
    then held as one array of their numbers."""
    rate = float(labels.mean()) if len(labels) else 0.0
    if rate in (0.0, 1.0):
        return {"weights": np.zeros(dims, np.float32), "bias": 0.0, "rate": rate}
    p, q = np.full(dims, smooth), np.full(dims, smooth)
    size = np.zeros(len(texts), np.int64)
    for k, (t, y) in enumerate(zip(texts, labels, strict=True)):
        x = features(t, dims, orders)
        size[k] = len(x)
        (p if y == 1 else q)[x] += 1
    ratio = np.log(p / (labels.sum() + 2 * smooth)) - np.log(q / ((1 - labels).sum() + 2 * smooth))
    ends = np.concatenate(([0], np.cumsum(size)))
    flat = np.empty(ends[-1], np.int32)
    for k, t in enumerate(texts):
        flat[ends[k] : ends[k + 1]] = features(t, dims, orders)
    blocks = [(i, min(i + BLOCK, len(size))) for i in range(0, len(size), BLOCK)]
    w, b = np.zeros(dims), float(np.log(rate / (1 - rate)))
    # Limited-memory BFGS on the mean log loss; sums go block by block of rows, so that feature numbers only are held
    def loss(w, b):
        u, g, z = w * ratio, np.zeros(dims), np.empty(len(size))
        for i, j in blocks:
            own, of = flat[ends[i] : ends[j]], np.repeat(np.arange(j - i), size[i:j])
            z[i:j] = np.bincount(of, weights=u[own], minlength=j - i) + b
            d = 1 / (1 + np.exp(-np.clip(z[i:j], -500, 500))) - labels[i:j]
            g += np.bincount(own, weights=d[of], minlength=dims)
        d = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels
        return float(np.logaddexp(0, z).mean() - (labels * z).mean() + penalty / 2 * (w @ w)), np.append(g * ratio / len(size) + penalty * w, d.mean())

    x = np.append(w, b)
    f, g = loss(x[:-1], x[-1])
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = -g, []
        for s, y in reversed(past):
            kept.append(a := (s @ d) / (s @ y))
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(past, reversed(kept), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        step = 1.0 if past else min(1.0, 1 / np.linalg.norm(g))
        while True:
            new = x + step * d
            f2, g2 = loss(new[:-1], new[-1])
            if f2 <= f + 1e-4 * step * (g @ d) or step < 1e-6:
                break
            step /= 2
        if (s := new - x) @ (y := g2 - g) > 1e-12:
            past = [*past, (s, y)][-8:]
        done = f - f2 < 1e-6 * max(1.0, abs(f))
        x, f, g = new, f2, g2
        if done:
            break
    return {"weights": (x[:-1] * ratio).astype(np.float32), "bias": float(x[-1]), "rate": rate}


def sample_of(docs: DataFrame, labels: DataFrame, column: str, learn, max_rows: int) -> DataFrame:
    """At most max_rows labelled texts (text, label), by a hash of the id; their ids are broadcast, max_rows at most. An id
    that repeats gives one text, the first by code point."""
    best = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).where(learn).groupBy("doc_id").agg(F.max(column).alias("_label"))
    chosen = best.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    return texts.select("text", F.col("_label").cast("double").alias("label"))


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", learn=None, max_rows: int = MAX_ROWS, dims: int = DIMS, orders: tuple = ORDERS) -> dict:
    sample = materialize(sample_of(docs, labels, column, F.lit(True) if learn is None else learn, max_rows), "labelled")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((y, t or "") for batch in batches for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))  # the same sums however rows arrive
        model = fit([t for _, t in rows], np.array([y for y, _ in rows]), dims, orders) if rows else {"weights": np.zeros(dims, np.float32), "bias": 0.0, "rate": 0.0}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return pickle.loads(sample.coalesce(1).mapInArrow(lean(fitted), "model binary").first()["model"])


def score(docs: DataFrame, model: dict, text: str = "text", dims: int = DIMS, orders: tuple = ORDERS) -> DataFrame:
    """All columns of docs, and score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    names = [*kept.columns, "score", "predicted"]
    at = names.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, rate = held.value["weights"], held.value["bias"], held.value["rate"]
        for batch in batches:
            got = np.empty(batch.num_rows)
            for a in range(0, batch.num_rows, 256):
                for k, t in enumerate(batch.column(at).slice(a, 256).to_pylist(), a):
                    z = bias + float(weights[features(t, dims, orders)].sum(dtype=np.float64))
                    got[k] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            if rate in (0.0, 1.0):
                got[:] = rate
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=names)

    schema = StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return kept.mapInArrow(lean(scored), schema)


def train_from(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> dict:
    """The model of the contract: labels of rows whose crc32 modulo 5 isn't 0."""
    return train(docs if docs is not None else read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "toxic", crc_mod("doc_id", 5) != 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train_from(spark, sf_dir)
    return score(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
