"""Cost-balanced packing of documents into fixed-length token sequences.

A sequence costs `linear * length + quadratic * sum of squared piece lengths` (attention stays inside a piece).
Documents longer than a sequence are cut into whole sequences and a rest; rests are placed in descending order, each
into the lowest-cost sequence that still holds it, and where none holds it whole, into the lowest-cost sequences with
remaining capacity, cut to fill them. The sequences opened hold exactly the tokens there are: whole ones, and for what
is left over sequences of powers of two, which need no padding.

Packing is local to windows of `window` tokens of a partition: memory is bounded, nothing is shuffled, a lost task is
redone alone and gives the same rows. Each window wastes nothing, so windows cost no padding.

Nulls: a null text is empty and gives the end id alone; a null doc_id stays null. Repeated rows are separate documents.
Very long texts are encoded whole, and cut only as ids. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read, trim
from .tokens import default_path, encoder

LENGTH = 2048
END_ID = 1
WINDOW = 1 << 21
ROWS = 256  # texts that are encoded at once
#: Pieces a worker remembers and bytes it cuts at once: packing runs beside the heaps that earlier stages have grown.
MEMO, SLICE = 150_000, 1 << 18
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def assign(sizes: list[int], capacity: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> Iterator[tuple[int, int, int, int, int]]:
    """Yields (document, start, length, sequence, offset) for every piece; sequences count from 0."""
    used = 0
    rests: list[tuple[int, int, int]] = []
    for k, n in enumerate(sizes):
        whole = n // capacity
        for i in range(whole):
            yield k, i * capacity, capacity, used, 0
            used += 1
        if rest := n - whole * capacity:
            rests.append((rest, k, whole * capacity))
    total = sum(r[0] for r in rests)
    over = total % capacity
    room = np.array([capacity] * (total // capacity) + [1 << b for b in range(over.bit_length() - 1, -1, -1) if over >> b & 1], np.int64)
    left, cost = room.copy(), np.zeros(len(room))
    rests.sort(key=lambda r: (-r[0], r[1]))
    for rest, k, start in rests:
        while rest:
            fits = np.where(left >= rest, cost, np.inf)
            b = int(fits.argmin())
            if fits[b] == np.inf:
                b = int(np.where(left > 0, cost, np.inf).argmin())
            n = min(rest, int(left[b]))
            yield k, start, n, used + b, int(room[b] - left[b])
            left[b] -= n
            cost[b] += linear * n + quadratic * n * n
            rest, start = rest - n, start + n


def _pack(ids: list, docs: list, first: int, with_ids: bool, capacity: int) -> tuple[dict, int]:
    out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    ids_out, lengths = [], {}
    for k, start, n, seq, offset in assign([len(x) for x in ids], capacity):
        piece = ids[k][start : start + n]
        for key, v in zip(out, (docs[k], start, n, zlib.crc32(piece.astype("<u4", copy=False)), len(ids[k]), first + seq, offset), strict=True):
            out[key].append(v)
        lengths[first + seq] = lengths.get(first + seq, 0) + n
        if with_ids:
            ids_out.append(piece.view(np.int32))
    out["sequence_length"] = [lengths[s] for s in out["sequence_id"]]
    if with_ids:
        out["ids"] = ids_out
    return out, max(lengths, default=first - 1) + 1


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """docs: doc_id, text. A row for each piece; with_ids adds its ids (array<int>), the packed sequences themselves."""
    path = path or default_path()
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        enc, ids, names, total = encoder(path, MEMO, SLICE), [], [], 0
        end = np.array([end_id], np.uint32)
        names_out = [part.split()[0] for part in schema.split(", ")]

        def emit():
            nonlocal first, ids, names, total
            out, first = _pack(ids, names, first, with_ids, length)
            ids, names, total = [], [], 0
            kinds = {"ids": pa.list_(pa.int32())}
            return pa.RecordBatch.from_arrays([pa.array(out.pop(k), kinds.get(k, pa.int64())) for k in names_out], names=names_out)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                flat, ends = enc.encode(some.column(1).to_pylist())
                for doc, a, b in zip(some.column(0).to_pylist(), [0, *ends[:-1]], ends, strict=True):
                    ids.append(np.concatenate((flat[a:b], end)))
                    names.append(doc)
                    total += len(ids[-1])
                if total >= window:
                    yield emit()
                    trim()
        if ids:
            yield emit()

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(lean(packed, "tokens"), schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, of pieces with ids: a sequence is at most `length` of them."""
    held = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return held.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
