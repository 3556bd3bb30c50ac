"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction; a vector belongs to those whose caps it lies in. Directions are the words of a structured
random product code: the space, randomly rotated, is cut into two blocks, each with random unit vectors as words, and a
direction is one word of each, so `m0 * m1` directions need `m0 + m1` words (few dimensions: one block). A vector is
list-decoded to all directions whose sum of products reaches the level: the words of a block are looked at only as far
as the best of the other block can still lift them over it. A vector that exceeds fewer than `LEAST` directions there
has a lower level of its own, that of its `LEAST`-th best, so none is left with few caps; no list is cut short.

The code is fitted to the dimensions and the number of vectors: it starts at about `CELL` vectors expected a direction
and is made coarser until, of `TRIED` simulated pairs at the threshold itself, at least `RECALL` share a direction.
Before it is made coarser than a quarter, vectors get two or four times as many directions. `exact=True` takes a code of one direction: all pairs are compared, at quadratic cost.

Vectors are joined on directions. What is shuffled is sent once for each first word of a vector's directions, not once
for each direction; a task has all vectors of one first word, sets their cells (directions) up and verifies the pairs of
each by cosine in double precision. Only counts and a spanning forest leave it. A pair that meets in several directions
counts in the smallest it shares. First words of more vectors than fit are dealt by direction instead, and directions of
more than `CHUNK` of these vectors are cut into chunks, each pair of chunks being a task's work: no vector is dropped.

Equal vectors are one row with a count before all this. Links that are reported are exact (cosine >= threshold).

Defined results: vectors that are null, zero or hold nulls or non-finite numbers link with nothing: n_links 0, their own
component. Components are scaled by a power of two before they are squared, so very small and very large vectors link
like others. Vectors of different lengths don't link. Rows that share a vec_id are one node, counted once for each row;
rows with a null vec_id are kept, with n_links null, a null component and kept false, and link with nothing. An empty
table gives no rows; extra columns (labels) are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import dimension, drop, lean, materialize, read
from .graph import components

THRESHOLD = 0.95
LEAST = 24  # directions that every vector has
FEW = 16  # dimensions below which the code has one block
CELL = 4  # vectors expected a direction
RECALL, TRIED = 0.999, 2_000
BUCKET_BYTES = 1 << 24  # of a first word's vectors in one task
CHUNK = 1024
SMALL = 64  # vectors of a cell whose pairs are listed one by one; larger cells are matrix products
SEED = 7


class Code:
    """Rotation, words of the one or two blocks, level, and the directions that a vector has at least."""

    def __init__(self, dims: int, m0: int, m1: int, least: int = LEAST, level: float = -np.inf):
        self.m0, self.m1, self.least, self.level = m0, m1, least, level
        rng = np.random.default_rng(SEED + dims)
        blocks = 1 if dims < FEW else 2
        wide = -(-dims // blocks) * blocks
        self.rotation = np.linalg.qr(rng.standard_normal((wide, wide)))[0][:dims].astype(np.float32)
        words = [rng.standard_normal((m, wide // blocks)) for m in (m0, m1)[:blocks]]
        self.words = [(w / np.linalg.norm(w, axis=1, keepdims=True)).astype(np.float32) for w in words]

    def products(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of unit vectors with the words of the two blocks (zeros where there is but one)."""
        y = x.astype(np.float32) @ self.rotation
        width = self.words[0].shape[1]
        second = y[:, width:] @ self.words[1].T if len(self.words) == 2 else np.zeros((len(x), 1), np.float32)
        return y[:, :width] @ self.words[0].T, second

    def own_level(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The `least`-th best sum of each row; the best `least` words of each block hold it."""
        n = self.least
        top = lambda v: -np.partition(-v, n - 1, axis=1)[:, :n] if v.shape[1] > n else v
        sums = (top(p)[:, :, None] + top(q)[:, None, :]).reshape(len(p), -1)
        return -np.partition(-sums, n - 1, axis=1)[:, n - 1] if sums.shape[1] > n else sums.min(axis=1)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All directions of each row at its level, ascending, in one array; and how many each row has."""
        p, q = self.products(x)
        level = np.minimum(np.float32(self.level), self.own_level(p, q))
        row, first = np.nonzero(p + q.max(axis=1)[:, None] >= level[:, None])
        found, of = [], []
        step = max(1, (1 << 22) // q.shape[1])
        for at in range(0, len(row), step):
            r, i = row[at : at + step], first[at : at + step]
            k, j = np.nonzero(p[r, i][:, None] + q[r] >= level[r][:, None])
            found.append(i[k].astype(np.int64) * self.m1 + j)
            of.append(r[k])
        return np.concatenate(found), np.bincount(np.concatenate(of), minlength=len(x))


def simulated(dims: int, n: int, cosine: float, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of random unit vectors at that cosine."""
    rng = np.random.default_rng(seed)
    x, z = rng.standard_normal((2, n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    y = cosine * x + (1 - cosine * cosine) ** 0.5 * z
    return x, y / np.linalg.norm(y, axis=1, keepdims=True)


def recall(code: Code, x: np.ndarray, y: np.ndarray) -> float:
    """The share of pairs that have a direction in common."""
    met = 0
    for at in range(0, len(x), 250):
        (a, n), (b, m) = (code.decode(v[at : at + 250]) for v in (x, y))
        top = code.m0 * code.m1
        some = np.intersect1d(np.repeat(np.arange(len(n)), n) * top + a, np.repeat(np.arange(len(m)), m) * top + b)
        met += len(np.unique(some // top))
    return met / len(x)


@functools.lru_cache(64)
def fitted(dims: int, vectors: int, threshold: float = THRESHOLD, exact: bool = False, bucket_bytes: int = BUCKET_BYTES) -> Code:
    """The finest code for that many vectors, with the fewest directions a vector, that reaches RECALL. The level is what
    nine vectors in ten exceed LEAST (or more) directions below."""
    if exact or dims == 1:
        return Code(dims, 1, 1)
    wanted = max(1, -(-vectors * LEAST // CELL))
    if dims < FEW:
        m0, m1 = min(wanted, 1 << 14), 1
    else:
        m0 = 1 << max(4, (vectors * 128 * dims // bucket_bytes).bit_length())
        m1 = max(16, -(-wanted // m0))
    x, y = simulated(dims, TRIED, threshold)
    while True:
        best = 0.0
        for least in (LEAST, 2 * LEAST, 4 * LEAST):
            for finer in (1, 2, 4):
                n0, n1 = (m0, max(1, m1 // finer)) if m1 > 1 else (max(1, m0 // finer), 1)
                code = Code(dims, n0, n1, least)
                if n0 * n1 <= least:
                    return code
                code.level = float(np.quantile(np.concatenate([code.own_level(*code.products(x[a : a + 250])) for a in range(0, len(x), 250)]), 0.9))
                best = recall(code, x, y)
                if best >= RECALL:
                    return code
                if best < 0.9:
                    break
            if best < 0.9:  # more directions won't do
                break
        m0, m1 = (m0, m1 // 8) if m1 > m0 else (m0 // 8, m1)


@functools.lru_cache(8)
def made(dims: int, m0: int, m1: int, least: int, level: float) -> Code:
    return Code(dims, m0, m1, least, level)


def vectors_of(column: pa.ListArray) -> list[np.ndarray | None]:
    """Each row's vector, or None if it links with nothing: null, empty, zero, or with a null or non-finite component."""
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    fine = np.isfinite(flat)
    out: list[np.ndarray | None] = []
    for null, a, b in zip(column.is_null().to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        v = flat[a:b]
        out.append(v if not null and b > a and fine[a:b].all() and v.any() else None)
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled by powers of two so that no square over- or underflows."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


class Lists:
    """The directions of each of some rows, ascending."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat, size
        self.start = np.cumsum(size) - size
        self.top = int(flat.max(initial=0)) + 1
        self.code = np.repeat(np.arange(len(size)), size) * self.top + flat

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in flat of the rows' directions, and the row (by its place in rows) of each."""
        n = self.size[rows]
        of = np.repeat(np.arange(len(rows)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.start[rows][of], of

    def least_shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The smallest direction that rows a and b share, pair by pair; they share one."""
        out = np.empty(len(a), np.int64)
        for at in range(0, len(a), 1 << 14):
            rows, others = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
            place, of = self.places(rows)
            asked = others[of] * self.top + self.flat[place]
            hit = np.searchsorted(self.code, asked)
            hit = self.code[np.minimum(hit, len(self.code) - 1)] == asked
            n = self.size[rows]
            out[at : at + len(rows)] = np.minimum.reduceat(np.where(hit, self.flat[place], np.iinfo(np.int64).max), np.cumsum(n) - n)
        return out

    def uncount(self, counted: np.ndarray, left: np.ndarray, right: np.ndarray, direction: int) -> None:
        """Clears pairs (of rows left and right) that share a direction below this one: they count there. Rows are looked
        at 64 at a time, against the directions of their partners."""
        some = np.flatnonzero(counted.any(axis=1))
        for at in range(0, len(some), 64):
            rows = some[at : at + 64]
            partners = np.flatnonzero(counted[rows].any(axis=0))
            low = np.unique(self.flat[self.places(left[rows])[0]])
            low = low[low < direction]
            if not len(low):
                continue

            def marks(of_rows: np.ndarray, low=low) -> np.ndarray:
                place, of = self.places(of_rows)
                own = self.flat[place]
                k = np.minimum(np.searchsorted(low, own), len(low) - 1)
                out = np.zeros((len(of_rows), len(low)), np.float32)
                out[of[low[k] == own], k[low[k] == own]] = 1
                return out

            shared = marks(left[rows]) @ marks(right[partners]).T > 0
            counted[np.ix_(rows, partners)] &= ~shared


class Bucket:
    """Rows that share a first word (or one direction), linked cell by cell."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, lists: Lists, threshold: float):
        self.ids, self.copies, self.x, self.lists, self.threshold = ids, copies, scaled(x), lists, threshold
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.links = np.zeros(len(ids), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def cells(self, first: int, wide: int) -> None:
        """All directions that begin with a first word."""
        flat, size = self.lists.flat, self.lists.size
        own = np.flatnonzero(flat // wide == first)
        row, d = np.repeat(np.arange(len(size)), size)[own], flat[own]
        order = np.argsort(d, kind="stable")
        row, d = row[order], d[order]
        begins = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        n = np.diff(np.append(begins, len(d)))
        some = np.repeat((n > 1) & (n <= SMALL), n)
        self.listed(row[some], d[some], np.sort(d[begins[n > SMALL]]), first, wide)
        for k in np.flatnonzero(n > SMALL).tolist():
            members = row[begins[k] : begins[k] + n[k]]
            self.compared(members, members, int(d[begins[k]]))

    def listed(self, row: np.ndarray, d: np.ndarray, large: np.ndarray, first: int, wide: int) -> None:
        """Small cells: rows sorted by direction; pairs k places apart, for each k that a cell has. A pair counts here if
        the smallest direction it shares is one of these cells'."""
        total, pairs, k = len(self.ids), [], 1
        while k < len(d) and len(at := np.flatnonzero(d[:-k] == d[k:])):
            a, b = row[at], row[at + k]
            pairs.append(np.minimum(a, b) * total + np.maximum(a, b))
            k += 1
        if not pairs:
            return
        code = np.unique(np.concatenate(pairs))
        for at in range(0, len(code), 1 << 15):
            a, b = np.divmod(code[at : at + (1 << 15)], total)
            near = np.einsum("ij,ij->i", self.x[a], self.x[b]) / (self.norm[a] * self.norm[b]) >= self.threshold
            if not near.any():
                continue
            a, b = a[near], b[near]
            self.edges.append((a, b))
            least = self.lists.least_shared(a, b)
            counts = (least // wide == first) & ~np.isin(least, large)
            np.add.at(self.links, a[counts], self.copies[b[counts]])
            np.add.at(self.links, b[counts], self.copies[a[counts]])

    def compared(self, left: np.ndarray, right: np.ndarray, direction: int) -> None:
        """One cell's pairs, inside (left is right) or across two chunks, as products of blocks."""
        inside = left is right
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            others = right[at:] if inside else right
            near = (self.x[rows] @ self.x[others].T) / (self.norm[rows][:, None] * self.norm[others][None, :]) >= self.threshold
            if inside:
                near[:, : len(rows)] &= np.tri(len(rows), len(rows), -1, bool).T
            if not near.any():
                continue
            a, b = np.nonzero(near)
            self.edges.append(_forest(rows[a], others[b], len(self.ids)))
            self.lists.uncount(near, rows, others, direction)
            self.links[rows] += near @ self.copies[others]
            self.links[others] += near.T @ self.copies[rows]

    def rows(self) -> list[tuple[int, int, int]]:
        """(id, links, smallest id it is linked with here) of rows that have either."""
        root = self.ids
        if self.edges:
            a, b = (np.concatenate(v) for v in zip(*self.edges, strict=True))
            order = np.argsort(self.ids, kind="stable")
            root = self.ids[order][_roots(np.argsort(order, kind="stable")[a], np.argsort(order, kind="stable")[b], len(order))][np.argsort(order, kind="stable")]
        some = np.flatnonzero((self.links > 0) | (root != self.ids))
        return list(zip(self.ids[some].tolist(), self.links[some].tolist(), root[some].tolist(), strict=True))


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row of each row's component: smallest labels spread along edges, and labels' labels with them."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, old[a], low)
        np.minimum.at(label, old[b], low)
        label = label[label]
        if (label == old).all():
            return label


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as keep the components of these."""
    rows = np.unique(np.concatenate((a, b)))
    label = _roots(np.searchsorted(rows, a), np.searchsorted(rows, b), len(rows))
    other = np.flatnonzero(label != np.arange(len(rows)))
    return rows[other], rows[label[other]]


def _bytes(column: pa.Array, kind: str) -> np.ndarray:
    """All values of a binary column without nulls, one after the other."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, kind, (at[-1] - at[0]) // np.dtype(kind).itemsize, at[0]) if len(column) and at[-1] > at[0] else np.empty(0, kind)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, exact: bool = False, bucket_bytes: int = BUCKET_BYTES, chunk: int = CHUNK) -> DataFrame:
    """vectors: vec_id, embedding. vec_id, n_links, component_id, kept of every row."""
    single = isinstance(vectors.schema["embedding"].dataType, ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    embedding = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding"))
    name = lambda x: hashlib.blake2b(x.tobytes(), digest_size=16).digest()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [x if i is not None else None for i, x in zip(batch.column(0).to_pylist(), vectors_of(batch.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else name(x) for x in good], pa.binary()), pa.array([None if x is None else len(x) for x in good], pa.int32())], names=["vec_id", "name", "dims"])

    names = materialize(rows.mapInArrow(lean(named), "vec_id long, name binary, dims int"), "names")
    several = names.where("name is not null").groupBy("name").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    several = materialize(several, "several")
    by_dims = {r["dims"]: r["n"] for r in names.where("dims is not null").groupBy("dims").agg(F.count("*").alias("n")).collect()}  # lengths of vectors are few
    codes = {d: (c.m0, c.m1, c.least, c.level) for d, n in by_dims.items() if (c := fitted(d, n, threshold, exact, bucket_bytes))}  # fitted once, so that all tasks decode alike
    wide = max((m0 * m1 for m0, m1, *_ in codes.values()), default=1) >= 1 << 31
    number = pa.int64() if wide else pa.int32()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [(i, x) for i, x in zip(batch.column(0).to_pylist(), vectors_of(batch.column(1)), strict=True) if i is not None and x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in good], pa.int64()), pa.array([name(x) for _, x in good], pa.binary()), pa.array([len(x) for _, x in good], pa.int32()), pa.array([x.astype(kind).tobytes() for _, x in good], pa.binary())], names=["vec_id", "name", "dims", "vector"])

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                dims = some.column(3).to_numpy(zero_copy_only=False)
                raw = some.column(4).to_pylist()
                lists: list = [None] * some.num_rows
                second = np.ones(some.num_rows, np.int32)
                for d in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == d)
                    code = made(d, *codes[d])
                    x = scaled(np.frombuffer(b"".join(raw[k] for k in own), kind).reshape(-1, d))
                    flat, size = code.decode(x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
                    for k, found in zip(own, np.split(flat, np.cumsum(size)[:-1]), strict=True):
                        lists[k] = found
                    second[own] = code.m1
                firsts = [np.unique(v // m) for v, m in zip(lists, second.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(second), pa.array(lists, pa.list_(number)), pa.array(firsts, pa.list_(number))], names=["rep", "copies", "name", "dims", "vector", "second", "directions", "firsts"])

    kept = rows.mapInArrow(lean(packed), "vec_id long, name binary, dims int, vector binary").join(dimension(several), "name", "left").where("rep is null or rep = vec_id")
    kept = kept.select(F.col("vec_id").alias("rep"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), "name", "dims", "vector")
    word = "bigint" if wide else "int"
    listings = materialize(kept.mapInArrow(lean(listing), f"rep long, copies long, name binary, dims int, vector binary, second int, directions array<{word}>, firsts array<{word}>"), "directions")
    # A row that repeats with its vec_id is there once for each
    own = listings.where("copies = 1").unionByName(listings.where("copies > 1").dropDuplicates(["name"])).drop("name")

    sizes = listings.select("dims", F.explode("firsts").alias("first")).groupBy("dims", "first").agg(F.count("*").alias("n"))
    hot = materialize(sizes.where(F.col("n") * F.col("dims") * 8 > bucket_bytes).select("dims", "first"), "hot")
    deal = ["dims", "bucket", "low", "high", "side", "rep", "copies", "second", "vector", "directions"]
    cells = own.select("*", F.explode("firsts").alias("bucket"))
    if hot.limit(1).count():
        cells = cells.join(dimension(hot.withColumnRenamed("first", "bucket")), ["dims", "bucket"], "left_anti")
    cells = cells.select("dims", F.col("bucket").cast("long"), F.lit(-1).alias("low"), F.lit(-1).alias("high"), F.lit(0).alias("side"), *deal[5:])
    if hot.limit(1).count():
        spread = own.select("*", F.explode("directions").alias("bucket")).withColumn("first", F.floor(F.col("bucket") / F.col("second")).cast(word)).join(dimension(hot), ["dims", "first"], "left_semi")
        chunks = materialize(spread.groupBy("dims", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("dims", "bucket", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "chunks")
        spread = spread.join(dimension(chunks), ["dims", "bucket"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        fine = spread.select("dims", F.col("bucket").cast("long"), F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).cast("int").alias("side"), *deal[5:])
        cells = cells.unionByName(fine)
    key = ("dims", "bucket", "low", "high")
    dealt = cells.select(*deal).repartition(*key).sortWithinPartitions(*key, "rep")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: list[tuple] = []

        def close() -> list[tuple[int, int, int]]:
            ids, copies, x, flat, size, side = (np.concatenate(v) for v in zip(*held, strict=True))
            if len(ids) < 2:
                return []
            bucket = Bucket(ids, copies, x, Lists(flat, size), threshold)
            _, b, low, high, second = now
            if low < 0:
                bucket.cells(b, second)
            elif low == high:
                every = np.arange(len(ids))
                bucket.compared(every, every, b)
            else:
                bucket.compared(np.flatnonzero(side == 0), np.flatnonzero(side == 1), b)
            return bucket.rows()

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["rep", "links", "root"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2, 3, 7)], axis=1)
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)])).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if (group := tuple(keys[a].tolist())) != now:
                    if held and (out := close()):
                        yield batch_of(out)
                    now, held = group, []
                some = batch.slice(a, b - a)
                lists = some.column(9)
                held.append((some.column(5).to_numpy(), some.column(6).to_numpy(), _bytes(some.column(8), kind).reshape(-1, group[0]), lists.flatten().to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()), some.column(4).to_numpy()))
        if held and (out := close()):
            yield batch_of(out)

    found = materialize(dealt.mapInArrow(lean(linked), "rep long, links long, root long"), "found")
    drop(listings)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.where("rep <> root").select(F.col("rep").alias("x"), F.col("root").alias("y"))
    # One vec_id with several vectors is one node: what is equal to one of them hangs together by it
    ids = names.where("name is not null").groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    again = names.join(dimension(materialize(ids, "ids")), "vec_id", "left_semi").join(dimension(several), "name").where("rep <> vec_id")
    joined = components(edges.union(again.select(F.col("vec_id").alias("x"), F.col("rep").alias("y"))))
    linked_names = several.select(F.col("name").alias("_name"), "rep", F.col("copies") - 1)
    out = names.select("vec_id", "name").join(dimension(linked_names.toDF("_name", "_rep", "_equal")), F.col("name") == F.col("_name"), "left")
    out = out.withColumn("_rep", F.coalesce("_rep", "vec_id"))
    counts = materialize(counts, "counts")
    out = out.join(dimension(counts.toDF("_of", "_links")), (F.col("_rep") == F.col("_of")) & F.col("name").isNotNull(), "left")
    out = out.join(dimension(joined.toDF("_node", "_comp")), F.col("_rep") == F.col("_node"), "left")
    component = F.coalesce("_comp", "_rep")
    links = F.when(F.col("vec_id").isNotNull(), F.coalesce("_links", F.lit(0)) + F.coalesce("_equal", F.lit(0))).cast("long")
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op4_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_sum(list_transform(embedding::DOUBLE[], lambda c: c * c)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.seen),
comps AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, k.component_id, e.vec_id = k.component_id AS kept
FROM embeddings e JOIN comps k ON k.node = e.vec_id LEFT JOIN counts c ON c.x = e.vec_id
"""
