"""The folder that driver and executors share, for tables that outlive a job: the session's spark.checkpoint.dir."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "steps") -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def few_rows_at_once(spark: SparkSession, n: int = 1000):
    """Texts are long: what is planned meanwhile passes fewer of them at once between the JVM and Python than Spark's 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def freed(spark: SparkSession) -> None:
    """Gives the disk of shuffles back that no table needs any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def stamp(spark: SparkSession, path: str) -> tuple:
    """What a table's files are now: paths, sizes and times."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return (path,)
    return (path, *sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)))
