"""N-gram Jaccard join by a token-group matrix: exact links between documents whose sets of word shingles are alike.

1. Groups of similar documents. A linked pair shares tokens among the rarest `n - ceil(t n) + l` of each, in any one
   order of tokens (frequent ones come last). A document's group key is the first frequent token among these: copies of
   a text that many copy have it in common, while a passage that unlike documents share comes after what is their own.
   Documents without one take two min-hashes as their key. Keys that many share are salted; groups have at most `CHUNK`
   distinct sets, and all their pairs are compared in their task, which emits components, not pairs.
2. The matrix: a group's union of its members' rarest tokens, one row for each token and group.
3. Bounds. Two groups can hold a linked pair only if their unions share as many tokens as their sizes ask for. Only such
   pairs of groups qualify.
4. Opening. A qualifying pair of groups is a task's work: the two groups' sets are compared there and only edges between
   components leave it. First each group is opened with one partner (a forest); pairs of groups that are one component
   after that aren't opened again, all others are.
5. Components: large-star, small-star over these edges.

Tokens are 64-bit hashes of shingles of whole texts; sets are compared by them, and the matrix holds them whole. The
frequent tokens that the order knows are a bounded list: the order steers costs, results don't depend on it. No list of a
token's documents is made.

Defined results: a null text, or one without words, has an empty set, links with nothing and is its own component; fewer
words than a shingle has are one shingle together. Equal texts link. A null doc_id is kept, with a null component, and
links with nothing. Rows that share a doc_id are one node, each with its own n_shingles. An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dimension, drop, lean, materialize, mix64, read
from .graph import components

WORDS = 5
THRESHOLD = 75  # hundredths
CHUNK = 128
COPIES = 32  # a set of more documents is grouped once, by its smallest doc_id
SHARED = 3  # the l below
#: The list of frequent tokens that the order of tokens knows; a bound on its size, not on what is compared.
FREQUENT = 100_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_POWERS: list[np.ndarray] = []
WINDOW = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64; at least n."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = []
        for b in (_BASE, _INVERSE):
            p = np.ones(max(n, WINDOW + (1 << 17)), np.uint64)
            size = 1
            while size < len(p):
                m = min(size, len(p) - size)
                p[size : size + m] = p[:m] * np.uint64(pow(b, size, 1 << 64))
                size *= 2
            _POWERS.append(p)
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, and where each text's words end. Long buffers are hashed in windows."""
    raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    ends_at = np.cumsum([len(r) + 1 for r in raws]) - 1
    buffer = b"\n".join([*raws, b""])
    hashes, places, at = [], [], 0
    while at < len(buffer):
        cut = _BLANK.search(buffer, at + WINDOW)
        end = cut.start() if cut else len(buffer)
        h, starts = _hashed(np.frombuffer(buffer, np.uint8, end - at, at))
        hashes.append(h)
        places.append(starts + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), ends_at)


def _hashed(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words of some bytes."""
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    if not space[-1]:
        edge = np.append(edge, len(b))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):  # slices of about a megabyte, or one long text
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size < 1 << 20):
            size += len(texts[upto] or "")
            upto += 1
        h, ends = word_hashes(texts[at:upto])
        rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            rolled = rolled * np.uint64(_BASE) + h[k : k + len(rolled)]
        rolled = mix64(rolled)
        a = 0
        for e in ends.tolist():
            if e - a >= words:
                out.append(np.unique(rolled[a : e - words + 1]))
            elif e > a:
                whole = 0
                for v in h[a:e].tolist():
                    whole = (whole * _BASE + v) % (1 << 64)
                out.append(mix64(np.array([(whole + 0x5851F42D4C957F2D * (e - a)) % (1 << 64)], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
            a = e
        at = upto
    return out


def links(x: np.ndarray, y: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether 100 * intersection >= threshold * union, of two sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < threshold * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= threshold * (len(x) + len(y) - both)


def least_shared(n: int, threshold: int = THRESHOLD) -> int:
    return -(-threshold * n // 100)


def rare_tokens(x: np.ndarray, frequent: np.ndarray, count: np.ndarray, threshold: int = THRESHOLD, shared: int = SHARED) -> np.ndarray:
    """The tokens of a set that any linked set shares `shared` of (or all it must share), in the order of tokens."""
    need = least_shared(len(x), threshold)
    take = len(x) - need + min(shared, need)
    if len(frequent):
        at = np.searchsorted(frequent, x)
        at[at == len(frequent)] = 0
        known = frequent[at] == x
        rare = x[~known]
        if len(rare) < take:
            often = x[known]
            rare = np.concatenate((rare, often[np.lexsort((often, count[at[known]]))]))
        return rare[:take]
    return x[:take]


def key_of(x: np.ndarray, doc, frequent: np.ndarray, count: np.ndarray, threshold: int = THRESHOLD) -> tuple[int, bool]:
    """The group key of a set (64 bits), and whether it is a frequent token."""
    if not len(x):
        return int(mix64(np.array([(doc or 0) % (1 << 64)], np.uint64))[0]), False
    if len(frequent):
        for_links = rare_tokens(x, frequent, count, threshold)
        at = np.searchsorted(frequent, for_links)
        at[at == len(frequent)] = 0
        known = np.flatnonzero(frequent[at] == for_links)
        if len(known):
            return int(for_links[known[0]]), True
    one, two = (int(mix64(x ^ np.uint64(seed)).min()) for seed in (0xA5A5_5A5A_1234_5678, 0x0F0F_F0F0_8765_4321))
    return (one * 31 + two) % (1 << 64), False


def frequent_tokens(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT tokens of many documents, sorted, and their counts (of windows in which they are frequent)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def often():
            token, count = np.unique(np.concatenate(held), return_counts=True)
            token, count = token[count > 3], count[count > 3]
            if len(token) > 4_000:
                top = np.argpartition(-count, 4_000)[:4_000]
                token, count = token[top], count[top]
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count.astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for x in shingle_sets(batch.column(0).slice(at, 1024).to_pylist(), words):
                    held.append(x)
                    n += len(x)
                if n > 1_000_000:
                    yield often()
                    held, n = [], 0
        if held:
            yield often()

    total = docs.select("text").mapInArrow(lean(counted), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = sorted((r["token"] % (1 << 64), r["n"]) for r in materialize(total.orderBy(F.col("n").desc(), "token").limit(FREQUENT), "frequent").collect())
    return np.array([t for t, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64)


def hot_keys(docs: DataFrame, frequent, words: int, threshold: int) -> tuple[dict[int, int], dict[bytes, int]]:
    """The keys of many documents and into how many chunks each is salted; and the sets of many documents (their
    digests) with the smallest doc_id of each. Both lists have fewer than 50,000 rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, count = frequent.value
        for batch in batches:
            keys: dict[bytes, int] = {}
            names: dict[bytes, tuple[int, int]] = {}
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                for doc, x in zip(some.column(0).to_pylist(), shingle_sets(some.column(1).to_pylist(), words), strict=True):
                    if doc is None or not len(x):
                        continue
                    key, often = key_of(x, doc, tokens, count, threshold)
                    if often:
                        name, key = digest(x), key.to_bytes(8, "big")
                        keys[key] = keys.get(key, 0) + 1
                        low, n = names.get(name, (doc, 0))
                        names[name] = min(low, doc), n + 1
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array([*keys, *names], pa.binary()), pa.array([None] * len(keys) + [low for low, _ in names.values()], pa.int64()), pa.array([*keys.values(), *(n for _, n in names.values())], pa.int64())], names=["name", "low", "n"])

    total = docs.select("doc_id", "text").mapInArrow(lean(counted), "name binary, low long, n long").groupBy("name").agg(F.min("low").alias("low"), F.sum("n").alias("n")).where(F.col("n") > COPIES)
    total = materialize(total, "keys")
    rows = total.agg(F.sum("n")).first()[0] or 0
    hot = total.where(F.col("n") > F.greatest(F.lit(rows // 50_000), F.when(F.col("low").isNull(), CHUNK).otherwise(COPIES))).collect()
    drop(total)
    signed = lambda key: int.from_bytes(key, "big", signed=True)
    return {signed(r["name"]): -(-r["n"] // CHUNK) for r in hot if r["low"] is None}, {bytes(r["name"]): r["low"] for r in hot if r["low"] is not None}


def digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


class Group:
    """Distinct sets of a task's group, linked as they come."""

    def __init__(self):
        self.sets: list[np.ndarray] = []
        self.ids: list[int] = []
        self.parent: list[int] = []
        self.exact: dict[bytes, int] = {}
        self.rows: list[tuple[int, int, int, bool]] = []  # doc_id, n, place of its set, whether the first of it

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)

    def add(self, doc: int, x: np.ndarray, threshold: int) -> None:
        name = digest(x)
        k = self.exact.get(name)
        first = k is None
        if first:
            k = self.exact[name] = len(self.sets)
            self.parent.append(k)
            for j, y in enumerate(self.sets):
                if self.root(j) != self.root(k) and links(x, y, threshold):
                    self.join(j, k)
            self.sets.append(x)
            self.ids.append(doc)
        self.rows.append((doc, len(x), k, first))


GROUPS = "doc_id long, n long, root long, grp long, first boolean, tokens array<long>, least long, most long"


def grouped(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """A row for each document: n, its group, its component's root in that group, whether it is the first of its set
    there; the group's first row has the union of tokens and the least and largest size. Materialised."""
    sc = docs.sparkSession.sparkContext
    frequent = sc.broadcast(frequent_tokens(docs, words))
    table = sc.broadcast(hot_keys(docs, frequent, words, threshold))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, count = frequent.value
        chunks, copied = table.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids, texts = some.column(0).to_pylist(), some.column(1).to_pylist()
                sets = shingle_sets(texts, words)
                key = np.array([key_of(x, i, tokens, count, threshold)[0] for x, i in zip(sets, ids, strict=True)], np.uint64).view(np.int64)
                own = (mix64(np.array([i or 0 for i in ids], np.int64).view(np.uint64)) >> np.uint64(1)).view(np.int64)
                salt = own % np.array([chunks.get(k, 1) for k in key.tolist()], np.int64)
                low: list[int | None] = [None] * len(ids)
                if copied:
                    for k, x in enumerate(sets):
                        rep = copied.get(digest(x)) if ids[k] is not None and len(x) else None
                        if rep is not None and rep != ids[k]:  # one of many copies: its text stays here
                            low[k], texts[k], key[k] = rep, None, own[k]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(salt), some.column(0), pa.array(texts, pa.string()), pa.array(low, pa.int64()), pa.array([len(x) for x in sets], pa.int64())], names=["key", "salt", "doc_id", "text", "low", "n"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, count = frequent.value
        now, group = None, Group()
        out: list[tuple] = []

        def close():
            if not group.rows:
                return
            union = np.unique(np.concatenate([rare_tokens(x, tokens, count, threshold).view(np.int64) for x in group.sets]))
            sizes = [len(x) for x in group.sets]
            for k, (doc, n, place, first) in enumerate(group.rows):
                more = (union, min(sizes), max(sizes)) if k == 0 else (None, None, None)
                out.append((doc, n, group.ids[group.root(place)], group.ids[0], first, *more))

        def batch_of(rows):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n", "root", "grp", "first", "tokens", "least", "most"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                keys, salts, ids, texts, lows, sizes = (some.column(i).to_pylist() for i in range(6))
                for key, salt, doc, low, n, x in zip(keys, salts, ids, lows, sizes, shingle_sets(texts, words), strict=True):
                    if low is not None or not n or doc is None:
                        out.append((doc, n, doc if low is None else low, None, False, None, None, None))
                        continue
                    if (key, salt) != now or len(group.sets) >= CHUNK:
                        close()
                        now, group = (key, salt), Group()
                    group.add(doc, x, threshold)
                if len(out) >= 512:
                    yield batch_of(out)
                    out.clear()
        close()
        if out:
            yield batch_of(out)

    rows = docs.mapInArrow(lean(keyed), "key long, salt long, doc_id long, text string, low long, n long")
    dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", F.col("doc_id").asc_nulls_first(), "text")
    return materialize(dealt.mapInArrow(lean(linked), GROUPS), "groups")


def qualifying(groups: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a < b) of groups whose unions share as many tokens as a linked pair of their sizes must."""
    matrix = groups.where("tokens is not null").select("grp", "least", "most", F.explode("tokens").alias("token"))
    shared = matrix.repartition("token").withColumn("c", F.count("*").over(Window.partitionBy("token"))).where("c > 1")
    found = materialize(shared.select("token", "grp", "least", "most"), "matrix")
    side = lambda n: found.select("token", F.col("grp").alias(n), F.col("least").alias(f"l{n}"), F.col("most").alias(f"m{n}"))
    fits = (100 * F.col("ma") >= threshold * F.col("lb")) & (100 * F.col("mb") >= threshold * F.col("la"))
    pairs = side("a").hint("merge").join(side("b"), "token").where((F.col("a") < F.col("b")) & fits)
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("la", "ma", "lb", "mb")])
    need = lambda n: F.ceil(threshold * n / 100)
    taken = lambda n: F.least(F.lit(SHARED), need(n))
    # All but the taken tokens of a set are past its rarest ones; what is shared beyond those is at most that many
    must = F.ceil(threshold * (F.col("la") + F.col("lb")) / (100 + threshold)) - F.greatest(*[need(F.col(n)) - taken(F.col(n)) for n in ("ma", "mb")])
    least = F.greatest(F.least(taken(F.col("la")), taken(F.col("lb"))), must)
    out = materialize(pairs.where(F.col("c") >= F.greatest(least, F.lit(1))).select("a", "b"), "qualifying")
    drop(found)
    return out


def opened(pairs: DataFrame, groups: DataFrame, docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """Edges (x, y) between components' roots that the comparison of all sets of pairs (a, b) of groups finds."""
    wanted = materialize(pairs.select(F.col("a").alias("grp")).union(pairs.select("b")).distinct(), "wanted")
    sets = groups.where("first").select("doc_id", "grp", "root").join(dimension(wanted), "grp", "left_semi")
    sets = materialize(sets, "sets")
    texts = materialize(docs.join(dimension(sets), "doc_id").select("doc_id", "grp", "root", "text"), "texts")
    aims = pairs.select("a", "b", F.col("a").alias("grp"), F.lit(0).alias("side")).union(pairs.select("a", "b", "b", F.lit(1)))
    cells = aims.join(texts, "grp").select("a", "b", "side", "doc_id", "root", "text")
    cells = cells.repartition("a", "b").sortWithinPartitions("a", "b", "side", "doc_id")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        left: list[tuple[int, np.ndarray]] = []
        right: list[tuple[int, np.ndarray]] = []
        memo: dict[str, np.ndarray] = {}

        def close():
            """Overlaps of each right set with all left ones at once; a pair of roots is linked once."""
            edges = set()
            if left and right:
                owner = np.repeat(np.arange(len(left)), [len(x) for _, x in left])
                flat = np.concatenate([x for _, x in left])
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                sizes = np.array([len(x) for _, x in left])
                for root, y in right:
                    a, b = np.searchsorted(flat, y, "left"), np.searchsorted(flat, y, "right")
                    n = b - a
                    hit = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    both = np.bincount(owner[hit], minlength=len(left))
                    for k in np.flatnonzero(100 * both >= threshold * (sizes + len(y) - both)):
                        if left[k][0] != root:
                            edges.add((left[k][0], root))
            return edges

        found: list[tuple[int, int]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                a, b, side, root = (some.column(k).to_pylist() for k in (0, 1, 2, 4))
                for p, q, s, r, x in zip(a, b, side, root, shingle_sets(some.column(5).to_pylist(), words), strict=True):
                    if (p, q) != now:
                        found += close()
                        now, left, right = (p, q), [], []
                    (right if s else left).append((r, x))
                if len(found) > 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["x", "y"])
                    found = []
        found += close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["x", "y"])

    out = materialize(cells.mapInArrow(lean(compared), "x long, y long").distinct(), "links")
    for df in (wanted, sets, texts):
        drop(df)
    return out


def jaccard_components(docs: DataFrame, text: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    groups = grouped(docs, words, threshold)
    members = groups.select("doc_id", "n", "root")
    pairs = qualifying(groups, threshold)
    # What the many copies of a set point at is linked with its root
    copied = groups.where("grp is null and root <> doc_id").select(F.col("root").alias("x")).distinct()
    copied = materialize(copied, "copied")
    edges = groups.where("first and root <> doc_id").select(F.col("doc_id").alias("x"), F.col("root").alias("y")).join(dimension(copied), "x", "left_semi")
    edges = materialize(edges, "copies")
    joined = None
    if pairs.limit(1).count():
        forest = materialize(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "forest")
        edges = edges.unionByName(opened(forest, groups, docs, words, threshold))
        joined = components(edges)
        # A group is settled if all its roots are one component
        roots = groups.where("first").select("grp", "root").distinct()
        comps = roots.join(dimension(joined), roots["root"] == joined["node"], "left").select("grp", F.coalesce("comp", "root").alias("comp"))
        settled = materialize(comps.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high")), "settled")
        of = lambda n: settled.select(F.col("grp").alias(n), F.col("low").alias(f"l{n}"), F.col("high").alias(f"h{n}"))
        rest = pairs.join(forest, ["a", "b"], "left_anti").join(of("a"), "a").join(of("b"), "b")
        rest = materialize(rest.where("not (la = ha and lb = hb and la = lb)").select("a", "b"), "rest")
        if rest.limit(1).count():
            joined = components(edges.unionByName(opened(rest, groups, docs, words, threshold)))
    elif edges.limit(1).count():
        joined = components(edges)
    if joined is not None:
        members = members.join(dimension(joined), members["root"] == joined["node"], "left").select("doc_id", "n", F.coalesce("comp", "root").alias("root"))
    return members.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.seen)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.comp AS component_id
FROM sets s JOIN (SELECT node, min(seen) AS comp FROM reach GROUP BY node) r ON r.node = s.doc_id
"""
