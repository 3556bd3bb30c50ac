"""WARC archives: writing pages with revisits, and reading archives back by boundary-chain verification.

Reading. Every place where a file says "WARC/1.0" is a candidate; so is one inside a payload. Tasks read their split of a
file, cut at that magic, and emit for each candidate its offset and its successor's (its own plus what its header says
it takes). In a split, chains of candidates are contracted to the offset where they leave it. From offset 0 of each
file, pointer jumping over these exits (reached offsets and pointers double each round) finds where the file's true chain
enters each split; following it there marks the records. Whatever isn't reached is payload, however much it looks like a
record. A record whose payload holds the magic came in pieces; a second read puts them together, for such records alone.

Writing. A record is one string and the record terminator is the line separator of Spark's text writer, so any store
that Spark writes to will do, and the commit protocol keeps half-written files of lost executors out. Which pages are
revisits is found from (page_id, digest) rows; pages themselves aren't shuffled unless revisits are many.

Defined results: a null html is an empty payload; a null url writes no target; a null page_id writes none and comes back
as null. Of equal payloads of at least `least_bytes`, the records with the largest page_id are responses (all rows of
that id, should it repeat; rows without an id if no row has one), others revisit it. Line breaks in a url are
percent-encoded. Very long payloads are whole; an empty table writes no records. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dimension, lean, materialize, read, scratch

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
LEAST_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32(hexadecimal: Column) -> Column:
    """40 hexadecimal digits as 32 upper-case base32 characters: five digits are four characters."""
    groups = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _named(page_id: Column) -> Column:
    d = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    parts = [F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def roles(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, digest and refers_to of the pages that are revisits; narrow rows only."""
    rows = pages.select("page_id", "digest", "bytes").where(F.col("bytes") >= least_bytes)
    last = rows.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1").select(F.col("digest").alias("of"), "last")
    return rows.join(last, rows["digest"] == last["of"]).where(~F.col("page_id").eqNullSafe(F.col("last"))).select("page_id", "digest", F.col("last").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, where: str, least_bytes: int = LEAST_BYTES) -> None:
    """pages: page_id, url, html. Writes a record a row into text files under `where`."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", base32(F.sha1(F.col("html").cast("binary"))))
    revisits = materialize(roles(rows, least_bytes), "revisits")
    revisits = dimension(revisits).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to", F.lit(True).alias("revisit"))
    rows = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["_id"]) & (rows["digest"] == revisits["_digest"]), "left")
    is_revisit = F.coalesce(F.col("revisit"), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    length = F.octet_length(http) + F.when(is_revisit, 0).otherwise(F.col("bytes"))
    record = F.concat(
        F.lit(MAGIC),
        field("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", _named(F.col("page_id"))),
        field("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        field("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Page-ID", F.col("page_id").cast("string")),
        F.when(is_revisit, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", _named(F.col("refers_to"))), field("WARC-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(""),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
        F.when(is_revisit, "").otherwise(F.col("html")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(where)


def _parsed(value: Column) -> dict[str, Column]:
    """What a piece of a file after a magic says, read as a record's header and block. takes: bytes with the magic."""
    head = F.substring_index(value, END, 1)
    head_bytes = F.octet_length(head) + 4
    get = lambda name, kind=r"[^\r\n]*": F.nullif(F.regexp_extract(F.concat(F.lit("\r\n"), head), rf"(?i)\r\n{name}:[ \t]*({kind})", 1), F.lit(""))
    block_bytes = F.when(F.octet_length(head) < F.octet_length(value), get("Content-Length", r"\d{1,15}").cast("long"))
    block = F.substring(value.cast("binary"), head_bytes + 1, block_bytes.cast("int"))
    http_bytes = F.octet_length(F.substring_index(block.cast("string"), END, 1)) + 4
    payload = F.substring(block, http_bytes + 1, block_bytes.cast("int"))
    kind = get("WARC-Type")
    whole = F.octet_length(value) == head_bytes + block_bytes + 4
    revisit = kind == "revisit"
    said = F.regexp_extract(F.substring_index(block.cast("string"), END, 1), r"(?i)\r\nContent-Length:[ \t]*(\d{1,15})", 1)
    return {
        "takes": F.when(kind.isNotNull(), len(MAGIC) + head_bytes + block_bytes + 4),
        "whole": F.coalesce(whole, F.lit(False)),
        "kind": kind,
        "page_id": get("WARC-Page-ID").cast("long"),
        "url": get("WARC-Target-URI"),
        "refers_to": get("WARC-Refers-To-Page").cast("long"),
        "payload_bytes": F.when(whole, F.when(revisit, said.cast("long")).otherwise(block_bytes - http_bytes)),
        "payload_digest": F.when(whole, F.when(revisit, F.regexp_replace(get("WARC-Payload-Digest"), "^sha1:", "")).otherwise(base32(F.sha1(payload)))),
    }


def _pieces(spark: SparkSession, where: str) -> DataFrame:
    """file, split and value: what lies before, between and after the magics of each split, in order within a task."""
    text = spark.read.option("lineSep", MAGIC).text(where)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the pieces of each split, in order: at (of the magic before it, within the split's bytes) and leaves."""
    held: list[pa.RecordBatch] = []
    now = None

    def close():
        table = pa.Table.from_batches(held).combine_chunks()
        size = table.column("bytes").to_numpy() + len(MAGIC)
        at = np.cumsum(size) - size - len(MAGIC)
        takes = [None if t is None else t for t in table.column("takes").to_pylist()]
        index = {a: k for k, a in enumerate(at.tolist())}
        leaves: list[int | None] = [None] * len(at)
        for k in range(len(at) - 1, -1, -1):
            if takes[k] is not None:
                goes = int(at[k]) + takes[k]
                j = index.get(goes)
                leaves[k] = goes if j is None or takes[j] is None else leaves[j]
        out = table.append_column("at", pa.array(at)).append_column("leaves", pa.array(leaves, pa.int64()))
        return out.to_batches()

    for batch in batches:
        files, splits = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        a = 0
        for k in range(1, len(files) + 1):
            if k == len(files) or (files[k], splits[k]) != (files[a], splits[a]):
                if now is not None and (files[a], splits[a]) != now:
                    yield from close()
                    held = []
                now = files[a], splits[a]
                held.append(batch.slice(a, k - a))
                a = k
    if held:
        yield from close()


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, split, offset, next, entry) sorted by them: adds reached, following the chain from a split's entry."""
    now, goal = None, None
    for batch in batches:
        reached = []
        for file, split, offset, after, entry in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if (file, split) != now:
                now, goal = (file, split), entry
            hit = offset == goal and after is not None
            if hit:
                goal = after
            reached.append(hit)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reached, pa.bool_())], names=[*batch.schema.names, "reached"])


def read_archives(spark: SparkSession, where: str) -> DataFrame:
    """A row for each true record: file, offset, kind, page_id, url, refers_to, payload_bytes, payload_digest."""
    pieces = _pieces(spark, where)
    parsed = _parsed(F.col("value"))
    narrow = pieces.select("file", "split", F.octet_length("value").cast("long").alias("bytes"), *[c.alias(n) for n, c in parsed.items()])
    schema = "file string, split long, bytes long, takes long, whole boolean, kind string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, at long, leaves long"
    found = materialize(narrow.select("file", "split", "bytes", F.col("takes").cast("long").alias("takes"), *list(parsed)[1:]).mapInArrow(lean(_contracted), schema), "candidates")
    # Where each split's bytes begin: the sizes of the splits before it (a row a split)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = found.groupBy("file", "split").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("size")).withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).select("file", "split", "base")
    base = materialize(base, "splits")
    found = found.join(dimension(base), ["file", "split"]).withColumn("offset", F.col("base") + F.col("at")).withColumn("next", F.col("offset") + F.col("takes")).withColumn("exit", F.col("base") + F.col("leaves"))
    entries = _entries(found, base)
    dealt = found.join(dimension(entries), ["file", "split"], "left").select("file", "split", "offset", "next", "entry", "whole", "kind", "page_id", "url", "refers_to", "payload_bytes", "payload_digest")
    dealt = dealt.repartition("file", "split").sortWithinPartitions("file", "split", "offset")
    marked = materialize(dealt.mapInArrow(lean(_marked), f"{', '.join(f'{n} {t}' for n, t in dealt.dtypes)}, reached boolean"), "marked")
    columns = ["file", "offset", "kind", "page_id", "url", "refers_to", "payload_bytes", "payload_digest"]
    records = marked.where("reached and whole").select(*columns)
    broken = marked.where("reached and not whole").select("file").distinct()
    if not broken.limit(1).count():
        return records
    return records.unionByName(_joined(pieces, marked, base, broken).select(*columns))


def _entries(found: DataFrame, base: DataFrame) -> DataFrame:
    """file, split, entry: the offset at which the true chain enters each split it has a record in."""
    nodes = found.where("takes is not null").select("file", "split", "offset", "exit")
    aims = nodes.select("file", F.col("exit").alias("offset")).union(base.select("file", F.lit(0).cast("long"))).distinct()
    nodes = materialize(nodes.join(aims, ["file", "offset"]), "nodes")
    reached = materialize(nodes.where("offset = 0").select("file", "offset"), "reached")
    jump = nodes.select("file", "offset", "exit")
    n = reached.count()
    while True:
        hop = jump.select("file", F.col("offset"), F.col("exit").alias("to"))
        more = reached.join(hop, ["file", "offset"]).select("file", F.col("to").alias("offset")).join(nodes.select("file", "offset"), ["file", "offset"], "left_semi")
        reached = materialize(reached.union(more).distinct(), "reached")
        if (now := reached.count()) == n:
            break
        n = now
        jump = materialize(hop.join(jump.select("file", F.col("offset").alias("to"), F.col("exit")), ["file", "to"]).select("file", "offset", "exit"), "jump")
    return materialize(nodes.join(reached, ["file", "offset"]).groupBy("file", "split").agg(F.min("offset").alias("entry")), "entries")


def _joined(pieces: DataFrame, marked: DataFrame, base: DataFrame, files: DataFrame) -> DataFrame:
    """The records that hold the magic, put together from their pieces."""
    last = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.join(files, "file", "left_semi").withColumn("owner", F.last(F.when(F.col("reached"), F.struct("offset", "whole")), ignorenulls=True).over(last))
    owned = materialize(owned.where(~F.col("owner.whole")).select("file", "offset", F.col("owner.offset").alias("owner")), "owned")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            offsets = []
            for file, split, start, size in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (file, split) != now:
                    now, at = (file, split), start
                offsets.append(at - len(MAGIC))
                at += size + len(MAGIC)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(offsets, pa.int64()), batch.column(4)], names=["file", "offset", "value"])

    rows = pieces.join(dimension(files), "file", "left_semi").join(dimension(base), ["file", "split"]).select("file", "split", "base", F.octet_length("value").cast("long"), F.col("value").cast("binary").alias("value"))
    rows = rows.mapInArrow(lean(placed), "file string, offset long, value binary").join(owned, ["file", "offset"])
    whole = rows.groupBy("file", F.col("owner").alias("offset")).agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("p"))
    value = F.array_join(F.transform("p", lambda x: x["value"].cast("string")), MAGIC)
    return whole.select("file", "offset", value.alias("value")).select("file", "offset", *[c.alias(n) for n, c in _parsed(F.col("value")).items()])


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), where)
    return read_archives(spark, where).select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
e AS (
  SELECT page_id, payload_bytes, translate(array_to_string(list_transform(range(0, 8), lambda k: lpad(to_base(('0x' || substr(h, (1 + 5 * k)::INT, 5))::BIGINT, 32), 4, '0')), ''),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM d),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM e)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN NULL ELSE last END AS refers_to
FROM f
"""
