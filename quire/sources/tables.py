"""The engine's logical tables over a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T

from . import scratch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as texts: _id, corpus, id, title, author, year, genre, text."""
    d = table(spark, folder, "documents")
    genre = F.when(F.col("lang") == "en", "Fiction").when(F.col("lang") == "fr", "Poetry").when(F.col("lang") == "de", "Drama").otherwise("Essay")
    return d.select(
        F.concat(F.lit("_"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("_id"),
        F.col("source").alias("corpus"),
        F.col("doc_id").cast("string").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("lang").alias("author"),
        (F.lit(1600) + F.col("doc_id") % 300).cast("int").alias("year"),
        genre.alias("genre"),
        "text",
    )


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as bibliographic records: few distinct names, so blocks are dense."""
    p = table(spark, folder, "part")
    return p.select(
        F.concat(F.lit("_"), "p_type", F.lit("/"), F.col("p_partkey").cast("string")).alias("_id"),
        F.col("p_type").alias("corpus"),
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("author"),
        (F.lit(1900) + F.col("p_size")).cast("int").alias("year"),
    )


def word_index(texts: DataFrame) -> DataFrame:
    """One row for each text and word: the columns of texts but the text itself, word, count.

    Words are those of quire.functions.text.tokens that begin with a letter and hold nothing but letters, `-` and `'`.
    They are exploded before they are trimmed, so that trimming and counting run in generated code, and judged once they
    are counted: a word once a text, not at each place."""
    kept = [c for c in texts.columns if c != "text"]
    pieces = texts.select(*kept, F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_'\-]+")).alias("w"))
    counts = pieces.select(*kept, F.btrim("w", F.lit("_'-")).alias("word")).where("word <> ''").groupBy(*kept, "word").agg(F.count("*").alias("count"))
    return counts.where(T.is_word("word"))


#: Word indexes that this session has written, by application and by the files they were counted from.
_STORED: dict[tuple, DataFrame] = {}


def stored_index(spark: SparkSession, folder: str) -> DataFrame:
    """The word index of all documents, counted once and kept as a table, as a library keeps its own. Questions read the
    columns they ask for. A folder whose files change is counted anew."""
    key = (spark.sparkContext.applicationId, *scratch.stamp(spark, f"{folder}/documents.parquet"))
    if key not in _STORED:
        _STORED[key] = scratch.kept(word_index(texts(spark, folder).select("_id", "corpus", "id", "year", "genre", "text")), "word-index")
        scratch.freed(spark)
    return _STORED[key]
