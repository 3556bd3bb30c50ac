"""What the training-data operators share: the shared folder, materialised tables, deterministic hashes and bucket bounds."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every contract of this package: space and \t \n \v \f \r.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Rows, and bytes written, up to which a table is a broadcast candidate; above either joins shuffle.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20


#: Rows of texts that pass between the JVM and Python at once, unless the session asks for another number.
ARROW_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Texts are long: Spark's 10,000 rows a batch take hundreds of megabytes outside the heap."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


#: What a Python worker keeps from task to task, by operator: functions that forget it.
MEMOS: dict = {}


def lean(f, keeps: str = ""):
    """A mapInArrow function for workers that serve many operators: it forgets what others keep, and afterwards gives
    freed memory back, which would else stay with the worker beside the heap of its executor."""

    def run(batches):
        from quire.llm import common  # the worker's own; a closure's globals are copies

        for name, forget in common.MEMOS.items():
            if name != keeps:
                forget()
        yield from f(batches)
        trim()

    return run


def trim() -> None:
    """Gives freed memory back to the system: Arrow's pool keeps its own, beside what malloc keeps."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only where it is unset and Spark is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and a lost executor costs nothing.

    The path is kept on the result as .quire_path, for drop()."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    small_batches(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quire_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df.quire_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dimension(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcasts a materialised table whose counted rows, and bytes where it is a file's, are few; otherwise the join
    shuffles (AQE splits skew)."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS and written(df) <= BROADCAST_BYTES else df.hint("merge")


def written(df: DataFrame) -> int:
    """Bytes of what materialize() wrote; 0 for other tables."""
    if not getattr(df, "quire_path", None):
        return 0
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.quire_path)
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def aside(docs: DataFrame, *names: str):
    """docs with columns of these names (in any case) renamed, and a function that selects the columns of docs again, under
    their own names and with their own values."""
    moved, taken = {}, {c.lower() for c in docs.columns} | {n.lower() for n in names}
    for c in docs.columns:
        if c.lower() in {n.lower() for n in names}:
            new = "_" + c
            while new.lower() in taken:
                new = "_" + new
            moved[c] = new
            taken.add(new.lower())
    return docs.withColumnsRenamed(moved), lambda df: df.select(*[F.col(moved.get(c, c)).alias(c) for c in docs.columns])


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def id_bounds(df: DataFrame, key: str, per_bucket: int) -> list[int]:
    """Ids that cut a table into runs of about per_bucket rows; the bounds are ids that occur. Reads the key column only."""
    n = df.count()
    buckets = min(20_000, max(1, -(-n // per_bucket)))
    if buckets == 1:
        return []
    cuts = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(key, cuts, max(10_000, 20 * buckets)).alias("b")).first()["b"] or []
    least = df.agg(F.min(key)).first()[0]
    return sorted({b for b in found if b != least})


def bucket_of(key: str, bounds: list[int]) -> Column:
    """0 for ids below the first bound (and null), i for ids from bound i-1 on: a binary search over a literal array."""
    if not bounds:
        return F.lit(0)
    wide = F.array(*[F.lit(int(b)) for b in bounds]) if len(bounds) < 64 else F.from_json(F.lit(str([int(b) for b in bounds])), "array<bigint>")
    return F.coalesce(F.size(F.filter(wide, lambda b: b <= F.col(key))), F.lit(0)) if len(bounds) < 512 else _search(key, bounds)


def _search(key: str, bounds: list[int]) -> Column:
    """Two levels: the block by its first bound, then inside the block."""
    step = int(len(bounds) ** 0.5) + 1
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.from_json(F.lit(str([int(b[0]) for b in blocks])), "array<bigint>")
    table = F.from_json(F.lit(str([[int(x) for x in b] for b in blocks])), "array<array<bigint>>")
    block = F.coalesce(F.size(F.filter(heads, lambda b: b <= F.col(key))), F.lit(0))
    inside = F.size(F.filter(F.element_at(table, block), lambda b: b <= F.col(key)))
    return F.when(block > 0, (block - 1) * step + inside).otherwise(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift, multiply); wraps silently."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
