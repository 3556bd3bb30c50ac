"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank in the corpus (most frequent first, ties by id), so that common ids are small. Four ranks
share a control byte, two bits each: the number of bytes (1 to 4, little-endian) that the rank takes in the data
section. Control and data bytes lie apart, so a reader turns control bytes into lengths by one table lookup and gathers
all values of a block with a few numpy operations.

A folder holds `ranks.bin` (unsigned 32-bit ids by rank) and `part-NNNNN.qtk` files. Documents ascend by id (null first,
repeated ids by their ids' bytes) within a file and from file to file. A file is a sequence of blocks:

    magic "QTK1", unsigned 32-bit: documents, tokens, control bytes, data bytes, flag (1: ids of documents may be null)
    signed 64-bit document ids, [bytes: 1 where null], unsigned 32-bit tokens a document, control bytes, data bytes

A block closes after a document when it has `block_tokens` tokens, so memory is bounded by that or the longest document.
Files are written under an attempt's own name and renamed, so a lost executor's half-written file is never read.

Nulls: a null text is empty: the end id alone; a null doc_id comes first and stays null. Very long texts are encoded
whole. Repeated rows are kept. An empty table writes no parts and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, drop, id_bounds, lean, materialize, read, scratch
from .tokens import default_path, encoder

END_ID = 0
MAGIC = b"QTK1"
HEAD = struct.Struct("<4s5I")
BLOCK_TOKENS = 1 << 18
DOCS_A_FILE = 8_000
#: Bytes of each of a control byte's four values.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint16).astype(np.uint8)
    octets = v.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), octets[np.arange(4) < size[:, None]].tobytes()


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """n values: lengths by table lookup, then one gather for each byte place."""
    size = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32)
    for place in (1, 2, 3):
        more = np.flatnonzero(size > place)
        if not len(more):
            break
        out[more] |= data[at[more] + place].astype(np.uint32) << np.uint32(8 * place)
    return out


def write_block(out, docs: list, counts: list[int], ranks: np.ndarray) -> None:
    control, data = encode_values(ranks)
    nulls = any(d is None for d in docs)
    out.write(HEAD.pack(MAGIC, len(docs), len(ranks), len(control), len(data), int(nulls)))
    out.write(np.array([d or 0 for d in docs], "<i8").tobytes())
    if nulls:
        out.write(bytes(int(d is None) for d in docs))
    out.write(np.array(counts, "<u4").tobytes())
    out.write(control)
    out.write(data)


def read_blocks(file) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, tokens a document, ranks) for each block."""
    while head := file.read(HEAD.size):
        magic, docs, tokens, control, data, nulls = HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError(f"not a block: {magic!r}")
        names = np.frombuffer(file.read(8 * docs), "<i8").tolist()
        if nulls:
            names = [None if x else d for d, x in zip(names, file.read(docs), strict=True)]
        counts = np.frombuffer(file.read(4 * docs), "<u4")
        yield names, counts, decode_values(np.frombuffer(file.read(control), np.uint8), np.frombuffer(file.read(data), np.uint8), tokens)


def filesystem(where: str):
    """A pyarrow filesystem and the path in it; any store that pyarrow knows by its URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(where if "://" in where or not where.startswith("file:") else "file://" + where[5:])


def id_type(path: str | None = None, end_id: int = END_ID) -> str:
    """The narrowest of two little-endian types that holds every id; what passes between tasks is written in it."""
    tokenizer = encoder(path or default_path()).tokenizer
    return "<u2" if max(end_id, *tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4"


def token_table(docs: DataFrame, kind: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, n and ids (of that type, the end id last) of every text."""
    path = path or default_path()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                flat, ends = enc.encode(some.column(1).to_pylist())
                flat = flat.astype(kind)
                raw = [flat[a:b].tobytes() + end for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(x) // len(end) for x in raw], pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(encoded, "tokens"), "doc_id long, n long, ids binary")


def frequency_ranks(tokens: DataFrame, kind: str) -> np.ndarray:
    """Ids by rank. One row for each id of the vocabulary reaches the driver: its size bounds it, not the corpus."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                raw = b"".join(batch.column(0).slice(at, 1024).to_pylist())
                some = np.bincount(np.frombuffer(raw, kind), minlength=len(total))
                some[: len(total)] += total
                total = some
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(lean(counted), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def write_token_files(docs: DataFrame, where: str, path: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, docs_a_file: int = DOCS_A_FILE) -> list[dict]:
    """Writes the files of all documents under `where`. Returns a row for each file (name, docs, tokens, and start: the
    ids of all documents in the files before it), in order."""
    spark = docs.sparkSession
    kind = id_type(path, end_id)
    wide = int(kind[-1])
    tokens = materialize(token_table(docs, kind, path, end_id), "tokens")
    by_rank = frequency_ranks(tokens, kind)
    if not len(by_rank):
        return []
    fs, folder = filesystem(where)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/ranks.bin") as out:
        out.write(by_rank.astype("<u4").tobytes())
    rank_of = np.zeros(int(by_rank.max()) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)
    bounds = id_bounds(tokens, "doc_id", docs_a_file)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = tokens.withColumn("bucket", bucket_of("doc_id", bounds)).repartition(min(len(bounds) + 1, max(parts, (len(bounds) + 1) // 4)), "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(where)
        state = {"bucket": None}

        def close():
            if state["bucket"] is None:
                return None
            flush()
            state["out"].close()
            name = f"part-{state['bucket']:05d}.qtk"
            fs.move(state["own"], f"{folder}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((state["bucket"], pa.int64()), (name, pa.string()), (state["n_docs"], pa.int64()), (state["n_tokens"], pa.int64()))], names=["bucket", "name", "docs", "tokens"])

        def flush():
            if state["docs"]:
                write_block(state["out"], state["docs"], state["counts"], ranks.value[np.frombuffer(b"".join(state["raw"]), kind)])
            state.update(docs=[], counts=[], raw=[], held=0)

        for batch in batches:
            for doc, raw, bucket in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != state["bucket"]:
                    if done := close():
                        yield done
                    own = f"{folder}/.part-{bucket:05d}-{uuid.uuid4().hex}"
                    state = {"bucket": bucket, "own": own, "out": fs.open_output_stream(own), "docs": [], "counts": [], "raw": [], "held": 0, "n_docs": 0, "n_tokens": 0}
                n = len(raw) // wide
                state["docs"].append(doc)
                state["counts"].append(n)
                state["raw"].append(raw)
                for k, v in (("held", n), ("n_docs", 1), ("n_tokens", n)):
                    state[k] += v
                if state["held"] >= block_tokens:
                    flush()
        if done := close():
            yield done

    files = [r.asDict() for r in dealt.select("doc_id", "ids", "bucket").mapInArrow(lean(written), "bucket long, name string, docs long, tokens long").collect()]
    start = 0
    for f in sorted(files, key=lambda f: f["bucket"]):
        f["start"], start = start, start + f["tokens"]
    drop(tokens)
    return sorted(files, key=lambda f: f["bucket"])


def read_token_files(spark: SparkSession, where: str, files: list[dict], with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone; with_ids adds its ids (array<long>)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(f["name"], f["start"]) for f in files], "name string, start long").repartition(len(files))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(where)
        by_rank = None
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if by_rank is None:
                    with fs.open_input_stream(f"{folder}/ranks.bin") as f:
                        by_rank = np.frombuffer(f.read(), "<u4")
                with fs.open_input_stream(f"{folder}/{name}") as f:
                    for docs, counts, ranks in read_blocks(f):
                        ids = by_rank[ranks]
                        ends = np.cumsum(counts, dtype=np.int64)
                        each = [ids[b - n : b] for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                        columns = [pa.array(docs, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts.astype(np.int64)), pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in each], pa.int64())]
                        if with_ids:
                            columns.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                        start += int(ends[-1]) if len(ends) else 0
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return listed.mapInArrow(lean(decoded), schema)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch(spark, "token-files")
    return read_token_files(spark, where, write_token_files(read(spark, sf_dir, "documents"), where))
