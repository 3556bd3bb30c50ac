"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer when the smallest hash of its inner s-mers lies at its first or last place.
That depends on the k-mer alone, so the same passage gives the same anchors wherever it stands. A text's anchors are the
places and hashes of its syncmers. Matching is positional: what is compared are pairs of anchors that follow each other,
with the distance between their places, so two texts match where the same anchors lie equally far apart. A fingerprint is
the `sketch` smallest distinct hashes of such pairs, ascending, eight hexadecimal digits each. Two fingerprints are as
alike as the share of the smallest hashes of both together that both have: an estimate of the Jaccard similarity of the
two sets of pairs, exact for texts of up to `sketch` pairs, and for all with a `size` of their number. `matched` compares
two texts' anchors themselves, place by place.

A text shorter than k is one anchor, at 0, of all its code points; one anchor alone is a pair with itself; a text without
characters has none: its fingerprint is the empty string, two empty fingerprints are alike (1.0), an empty and another
aren't (0.0).

The neighbour query needs the next document's text. Ids that cut the table into runs (from one pass over the ids) tell
each document its run; the first document of a run is also sent to the end of the run before. One shuffle moves each
text once, sorted within its run, and a run is read as a stream that holds two texts at a time. No run depends on a key
that repeats, except a doc_id that does.

Nulls: a null text is empty. A null doc_id comes before all others. Rows of the same doc_id are ordered by text (null
first); equal rows stay. A table of one document has itself as its next; an empty one gives no rows. Extra columns are
ignored. Very long texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, id_bounds, lean, mix64, read

K, S = 16, 6
SKETCH = 64
RUN = 1_000

_B = 0x9E3779B97F4A7C15


def _rolled(c: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all windows of n code points, n times 2 ** i at a time."""
    h, size, power = c, 1, _B
    out, done = None, 0
    while True:
        if n & size:
            if out is None:
                out, done = h, size
            else:  # windows of `done` followed by ones of `size`
                m = len(c) - done - size + 1
                out = out[:m] * np.uint64(power) + h[done : done + m]
                done += size
        size *= 2
        if size > n:
            return out
        m = len(c) - size + 1
        h = h[:m] * np.uint64(power) + h[size // 2 : size // 2 + m]
        power = power * power % (1 << 64)


def closed_syncmers(text: str | None, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places (code points) and 64-bit hashes of a text's closed syncmers, in order."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if not len(c):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(c) < k:
        return np.zeros(1, np.int64), mix64(_rolled(c, len(c)) + np.uint64(len(c)))
    inner = mix64(_rolled(c, s))
    w, least, size = k - s + 1, inner, 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    n = len(c) - k + 1
    least = np.minimum(least[:n], least[w - size : w - size + n])
    at = np.flatnonzero((inner[:n] == least) | (inner[w - 1 : w - 1 + n] == least))
    return at, mix64(_rolled(c, k)[at])


def sketch_of(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The smallest distinct hashes, by their upper 32 bits."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    if len(h) > 8 * size:  # the smallest few hold the smallest distinct ones, unless hashes repeat
        some = np.unique(np.partition(h, 4 * size)[: 4 * size])
        if len(some) >= size:
            return some[:size]
    return np.unique(h)[:size]


def spaced(places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash of each anchor, the next one and the distance between them; of a single anchor, its own."""
    if len(hashes) < 2:
        return hashes
    return mix64(hashes[:-1] * np.uint64(_B) + hashes[1:] + np.diff(places).astype(np.uint64))


def fingerprint(text: str | None, k: int = K, s: int = S, size: int = SKETCH) -> np.ndarray:
    return sketch_of(spaced(*closed_syncmers(text, k, s)), size)


def matched(a: str | None, b: str | None, k: int = K, s: int = S) -> list[tuple[int, int, int]]:
    """Stretches (place in a, place in b, code points) that two texts share: anchors with the same hash on the same
    diagonal, run by run; an anchor that repeats stands for its first place in b."""
    (pa_, ha), (pb, hb) = closed_syncmers(a, k, s), closed_syncmers(b, k, s)
    if not len(ha) or not len(hb):
        return []
    name, first = np.unique(hb, return_index=True)
    at = np.minimum(np.searchsorted(name, ha), len(name) - 1)
    hit = np.flatnonzero(name[at] == ha)
    x, y = pa_[hit], pb[first[at[hit]]]
    size = min(k, len(a or ""))
    out: list[tuple[int, int, int]] = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        if out and i - out[-1][0] == j - out[-1][1] and i <= out[-1][0] + out[-1][2]:
            out[-1] = (*out[-1][:2], i - out[-1][0] + size)
        else:
            out.append((i, j, size))
    return out


def spelled(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:size]
    return float(np.isin(both, a, assume_unique=True).__and__(np.isin(both, b, assume_unique=True)).mean())


def edit(text: str, following: str) -> str:
    """The last quarter of a text's code points replaced by as many (or all) of the following text's first."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m] if m else text


def anchors(docs: DataFrame, text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """doc_id, places and hashes: the positional anchors of every text (hashes as signed 64-bit numbers)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [closed_syncmers(t, k, s) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64()))], names=["doc_id", "places", "hashes"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(lean(made), "doc_id long, places array<long>, hashes array<long>")


def in_runs(docs: DataFrame, text: str = "text", run: int = RUN) -> DataFrame:
    """doc_id, text, bucket, extra: dealt by runs of ids and sorted; extra rows, last of a run, are the next run's first."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    bounds = id_bounds(rows, "doc_id", run)
    last = len(bounds)
    rows = rows.withColumn("bucket", bucket_of("doc_id", bounds))
    # A run's first rows also close the run before; the table's first rows close the last run.
    null_first = rows.where(F.col("doc_id").isNull()).limit(1).count() > 0
    least = None if null_first else rows.agg(F.min("doc_id")).first()[0]
    first = F.col("doc_id").eqNullSafe(F.lit(least).cast("long"))
    opens = first
    if bounds:  # the bound that a run begins with
        begin = F.element_at(F.from_json(F.lit(str([int(b) for b in bounds])), "array<bigint>"), F.greatest(F.col("bucket"), F.lit(1)).cast("int"))
        opens = opens | F.coalesce((F.col("bucket") > 0) & (F.col("doc_id") == begin), F.lit(False))
    place = lambda bucket, extra: F.struct(bucket.cast("int").alias("bucket"), F.lit(extra).alias("extra"))
    own = place(F.col("bucket"), False)
    twice = F.when(opens, F.array(own, place(F.when(first, F.lit(last)).otherwise(F.col("bucket") - 1), True))).otherwise(F.array(own))
    rows = rows.select("doc_id", "text", F.inline(twice))
    parts = min(last + 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (last + 1) // 4))
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


def neighbours(docs: DataFrame, text: str = "text", k: int = K, s: int = S, size: int = SKETCH, run: int = RUN) -> DataFrame:
    """For every document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def row(doc, own: str, sketch, following: str, next_sketch):
        edited = edit(own, following)
        other = fingerprint(edited, k, s, size) if edited != own else sketch
        return doc, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), spelled(sketch), spelled(other), likeness(sketch, other, size), likeness(sketch, next_sketch, size)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bucket = None  # the document whose next is awaited
        for batch in batches:
            out = []
            for doc, own, b, extra in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != bucket:
                    held, bucket = None, b
                own = own or ""
                if extra:  # only the first of a run's extra rows is anyone's next
                    if held:
                        out.append(row(*held, own, fingerprint(own, k, s, size)))
                        held = None
                    continue
                sketch = fingerprint(own, k, s, size)
                if held:
                    out.append(row(*held, own, sketch))
                held = doc, own, sketch
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=list(names))

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_runs(docs, text, run).mapInArrow(lean(compared), schema)


def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "documents"))
