"""Structured Streaming over the same operators: an extension, as a corpus grows by files.

Word counts are kept as one Parquet folder for each micro-batch, written under the batch's own name, so a batch that runs
again after a failure replaces what it wrote; readers sum over the folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T


def text_stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def count_words(stream: DataFrame, out: str, checkpoint: str, text: str = "text"):
    """Starts a query that counts the words of each micro-batch and ends when there is nothing new."""

    def write(batch: DataFrame, number: int) -> None:
        words = batch.select(F.explode(T.tokens(text)).alias("word")).where(T.is_word("word"))
        words.groupBy("word").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("word").agg(F.sum("n").alias("n"))


def windowed(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts in event-time windows; rows later than the watermark are dropped, state with them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def replace_corpora(stream: DataFrame, out: str, checkpoint: str):
    """Each micro-batch's corpora replace those written before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
