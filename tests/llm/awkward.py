"""Small tables with everything that goes wrong: nulls, empty and long texts, ties, repeated rows, clashing names."""

import pyarrow as pa
import pyarrow.parquet as pq

LONG = "lorem ipsum dolor sit amet consectetur " * 6000
BASE = " ".join(f"word{k} and thing{k * 7 % 31}" for k in range(60))
DOCS = [
    (1, BASE, "en", "s1"),
    (2, BASE, "en", "s1"),
    (3, BASE + " tail", "en", "s2"),
    (4, None, "en", "s2"),
    (5, "", "fr", None),
    (6, "   \n\t ", "fr", None),
    (7, "three short words", "de", "s3"),
    (8, "Three SHORT words", "de", "s3"),
    (9, LONG, "en", "s1"),
    (None, "no id at all here", None, "s4"),
    (11, "repeated row of a few words", "en", "s1"),
    (11, "repeated row of a few words", "en", "s1"),
    (12, 'api token = "' + "0123456789abcdef" * 2 + '01234567" end', "en", "s1"),
    (13, "é日本 ünï 🎉 " * 3, None, "ß"),
    (14, BASE.replace("word3 ", "other3 "), "en", "s1"),
]


def documents(rows=DOCS):
    columns = {
        "doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string()),
        "n_chars": pa.array([len(r[1]) if r[1] is not None else None for r in rows], pa.int64()),
    }
    for extra in ("score", "size", "key", "n", "token", "title", "label", "x", "bucket", "start", "_id", "_key", "ids", "target"):
        columns[extra] = pa.array([f"{extra}{k}" for k in range(len(rows))], pa.string())
    return pa.table(columns)


PAGES = [(1, "u1", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "u\r\nX: y", None), (4, "u", ""), (None, "u", "zz é"), (6, "u", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 3), (7, "u", "x" * 300_000), (8, "u", "same"), (8, "u", "same")]
VECTORS = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0, 0.0]), (3, [0.99, 0.1, 0.0, 0.0]), (4, [0.0, 1.0, 0.0, 0.0]), (5, None), (6, [0.0] * 4), (7, [float("nan")] * 4), (8, [1.0, None, 0.0, 0.0]), (9, [1.0, 0.0]), (10, []), (None, [1.0, 0.0, 0.0, 0.0]), (12, [0.0, 1.0, 0.0, 0.0]), (12, [0.0, 1.0, 0.0, 0.0])]


def write(folder, docs, pages, vectors, labels):
    pq.write_table(documents(docs), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"page_id": pa.array([r[0] for r in pages], pa.int64()), "url": pa.array([r[1] for r in pages], pa.string()), "html": pa.array([r[2] for r in pages], pa.string()), "digest": pa.array(["d"] * len(pages), pa.string()), "file": pa.array(["f"] * len(pages), pa.string())}), f"{folder}/pages.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in vectors], pa.int64()), "embedding": pa.array([r[1] for r in vectors], pa.list_(pa.float32())), "label": pa.array([1] * len(vectors), pa.int32()), "rep": pa.array([0] * len(vectors), pa.int32())}), f"{folder}/embeddings.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in labels], pa.int64()), "quality": pa.array([r[1] for r in labels], pa.int32()), "toxic": pa.array([r[2] for r in labels], pa.int32())}), f"{folder}/labels.parquet")
    return str(folder)
