"""Quality: a regularised quadratic discriminant over transformed document statistics.

Each text gives shares of kinds of bytes, word and line statistics and repetition, transformed to be nearer to normal:
logarithms of counts, arcsines of roots of shares. Each class has a mean and a covariance, the latter shrunk towards the
pooled one and that one's diagonal. The score is the logistic of the difference of the two log densities (Mahalanobis
distances by triangular solves with cached Cholesky factors) plus the log prior odds.

Statistics are one pass over every text, whole; what follows moves a few numbers a document. All labelled rows are
learned from: class counts, sums and products are summed partition by partition, so the driver sees one small table
whatever the corpus.

Nulls: a null text has the statistics of an empty one; a null doc_id is kept and scored; null labels, or labels without a
document, aren't learned from; of several labels of an id the largest counts. Repeated rows are scored each. With fewer
than two classes to learn from, every score is the rate of label 1 (0 without rows). Very long texts are read whole.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, lean, materialize, read

NAMES = ("words", "word_length", "upper", "digits", "stops", "symbols", "pipes", "bangs", "foreign", "entropy", "distinct", "commonest", "trigrams", "line_length", "repeated_lines", "longest_word")
TOWARDS_POOLED, TOWARDS_DIAGONAL, RIDGE = 0.1, 0.1, 1e-3

_KIND = np.zeros(256, np.int64)  # 0: others
for _k, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:'\"()-?", b"#$%&*+/<=>@[\\]^_`{}~", b"|", b"!", range(128, 256), b" \t\n\v\f\r"), 1):
    _KIND[list(_set)] = _k


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text, in the order of NAMES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    _, upper, lower, digits, stops, symbols, pipes, bangs, foreign, _ = np.bincount(_KIND, weights=histogram, minlength=10)
    n, size = len(words), len(raw)
    seen = histogram[histogram > 0] / size
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = raw.split(b"\n")
    root = lambda x: float(np.arcsin(min(1.0, max(0.0, x)) ** 0.5))
    return [
        float(np.log1p(n)),
        float(np.log(size / n)),
        root(upper / max(1.0, upper + lower)),
        root(digits / size),
        root(stops / size),
        root(symbols / size),
        root(pipes / size),
        root(bangs / size),
        root(foreign / size),
        float(-(seen * np.log(seen)).sum()),
        root(len(counts) / n),
        root(max(counts.values()) / n),
        root(len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2)),
        float(np.log(size / len(lines))),
        root(1 - len(set(lines)) / len(lines)),
        float(np.log(max(map(len, counts)))),
    ]


def statistics_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and x, the statistics of its text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                x = pa.array([statistics(t) for t in some.column(1).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([some.column(0), x], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(lean(made), "doc_id long, x array<double>")


def class_moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """labelled: x and label. For each label the count, sum and sum of outer products; summed by Spark."""
    d = len(NAMES)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, d)
            y = np.array(batch.column(1).to_pylist())
            for c in (0, 1):
                z = x[y == c]
                total[c] += np.concatenate(([len(z)], z.sum(axis=0), (z.T @ z).ravel()))
        c, k = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(k), pa.array(total.ravel())], names=["label", "k", "v"])

    rows = labelled.mapInArrow(lean(summed), "label long, k long, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in rows:
        total[r["label"], r["k"]] = r["v"]
    return {c: (total[c, 0], total[c, 1 : 1 + d], total[c, 1 + d :].reshape(d, d)) for c in (0, 1)}


def discriminant(moments: dict, towards_pooled: float = TOWARDS_POOLED, towards_diagonal: float = TOWARDS_DIAGONAL, ridge: float = RIDGE) -> dict:
    """Means, inverse Cholesky factors, log determinants and log prior odds, over standardised statistics."""
    n = moments[0][0] + moments[1][0]
    if not moments[0][0] or not moments[1][0]:
        return {"rate": moments[1][0] / n if n else 0.0}
    mean = (moments[0][1] + moments[1][1]) / n
    scale = np.sqrt(np.maximum(np.diag(moments[0][2] + moments[1][2]) / n - mean**2, 1e-12))
    means, spread = [], []
    for c in (0, 1):
        k, s, p = moments[c]
        means.append((s / k - mean) / scale)
        spread.append((p / k - np.outer(s / k, s / k)) / np.outer(scale, scale))
    pooled = (moments[0][0] * spread[0] + moments[1][0] * spread[1]) / n
    factors, logs = [], []
    for c in (0, 1):
        # A class of few rows leans on the pooled covariance more
        a = max(towards_pooled, len(mean) / (len(mean) + moments[c][0]))
        s = (1 - a) * spread[c] + a * pooled
        s = (1 - towards_diagonal) * s + towards_diagonal * np.diag(np.diag(s)) + ridge * np.eye(len(mean))
        factor = np.linalg.cholesky(s)
        factors.append(np.linalg.solve(factor, np.eye(len(mean))))
        logs.append(2 * float(np.log(np.diag(factor)).sum()))
    return {"mean": mean, "scale": scale, "means": means, "factors": factors, "logs": logs, "odds": float(np.log(moments[1][0] / moments[0][0])), "rate": None}


def apply(model: dict, x: np.ndarray) -> np.ndarray:
    if model["rate"] is not None:
        return np.full(len(x), model["rate"])
    z = (x - model["mean"]) / model["scale"]
    density = [-0.5 * ((((z - m) @ f.T) ** 2).sum(axis=1) + g) for m, f, g in zip(model["means"], model["factors"], model["logs"], strict=True)]
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + model["odds"], -500, 500)))


def score_table(stats: DataFrame, labels: DataFrame, column: str, learn) -> DataFrame:
    """stats: materialised statistics. doc_id, score (12 places), predicted for all; learned from labels where learn holds."""
    best = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).where(learn).groupBy("doc_id").agg(F.max(column).cast("long").alias("label"))
    held = stats.sparkSession.sparkContext.broadcast(discriminant(class_moments(stats.join(best, "doc_id").select("x", "label"))))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.round(apply(held.value, np.array(batch.column(1).to_pylist(), float).reshape(-1, len(NAMES))), 12)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.mapInArrow(lean(scored), "doc_id long, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(statistics_table(read(spark, sf_dir, "documents")), "statistics")
    out = score_table(stats, read(spark, sf_dir, "labels"), "quality", crc_mod("doc_id", 3) != 1)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
