"""Sinks: tables by kind, upserts by key, frequencies, corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.markup import escaped


#: Rows that a file of a driver's format takes; a larger table is refused, not cut.
DRIVER_ROWS = 1_000_000


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        df.select(*sorted(df.columns)).write.mode(mode).option("header", True).csv(path)
    elif kind == "tsv":
        df.write.mode(mode).options(header=True, sep="\t").csv(path)
    elif kind in ("json", "jsonl"):
        df.write.mode(mode).json(path)
    elif kind in ("xlsx", "feather", "pkl", "pickle"):
        n = df.limit(DRIVER_ROWS + 1).count()
        if n > DRIVER_ROWS:
            raise ValueError(f"{kind} files are written by the driver: at most {DRIVER_ROWS} rows")
        frame = df.toPandas()
        {"xlsx": frame.to_excel, "feather": frame.to_feather, "pkl": frame.to_pickle, "pickle": frame.to_pickle}[kind](path)
    else:
        df.write.mode(mode).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, old_wins: bool = True) -> DataFrame:
    """Both tables' rows, one for each key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy(key).orderBy(F.col("_new").asc() if old_wins else F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_new")


def replace_corpus(texts: DataFrame, path: str) -> None:
    """Writes a corpus's rows over the ones it has; other corpora's partitions stay."""
    texts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus").parquet(path)


def write_frequencies(word_index: DataFrame, path: str) -> None:
    word_index.write.mode("overwrite").partitionBy("corpus").parquet(path)


def put(spark, path: str, key: str, value: str | None, at: float) -> None:
    """Sets a key (null value: deletes it) by appending; readers take the last."""
    spark.createDataFrame([(key, value, at)], "key string, value string, at double").write.mode("append").parquet(path)


def export(texts: DataFrame, folder: str) -> None:
    """A corpus as a folder: metadata as csv, texts as lines of id and text."""
    write(texts.drop("text"), f"{folder}/metadata.csv")
    write(texts.select("id", "text"), f"{folder}/texts.jsonl")


def write_gexf(edges: DataFrame, path: str) -> None:
    """edges (src, dst, weight) as a GEXF graph: a folder whose parts, put together in the order of their names, are the
    file. Sorted by ranges; no task holds the graph."""
    line = lambda place, key, text: (F.lit(place).alias("place"), key.alias("key"), text.alias("value"))
    fixed = edges.sparkSession.createDataFrame([(0, "", '<?xml version="1.0" encoding="UTF-8"?>\n<gexf version="1.3"><graph defaultedgetype="directed"><nodes>'), (2, "", "</nodes><edges>"), (4, "", "</edges></graph></gexf>")], "place int, key string, value string")
    nodes = edges.select("src").union(edges.select("dst")).distinct().toDF("n")
    quoted = lambda c: F.concat(F.lit('"'), escaped(F.col(c).cast("string")), F.lit('"'))
    node = nodes.select(*line(1, F.col("n").cast("string"), F.concat(F.lit("<node id="), quoted("n"), F.lit(" label="), quoted("n"), F.lit("/>"))))
    edge = edges.select(*line(3, F.col("src").cast("string"), F.concat(F.lit("<edge source="), quoted("src"), F.lit(" target="), quoted("dst"), F.lit(" weight="), quoted("weight"), F.lit("/>"))))
    fixed.unionByName(node).unionByName(edge).orderBy("place", "key").select("value").write.mode("overwrite").text(path)
