"""Sources: metadata tables, annotated layers, texts, frequencies, catalogue records and key-value stores."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import udfs
from quire.functions.markup import unescaped

#: Extensions of a table's annotated copies, the strongest first. Fixed values.
ANNOTATED = (".anno.xlsx", ".anno.xls", ".anno.csv", ".xlsx", ".xls", ".csv")


def metadata(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table by its extension: csv, tsv (also gzipped), json, jsonl, parquet, orc; xlsx, xls, feather, pickle and hdf by
    pandas on the driver, as these hold small tables. Delimited columns are strings; broken lines are dropped."""
    kind = path.removesuffix(".gz").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv", "txt"):
        return spark.read.options(header=True, mode="DROPMALFORMED", sep="," if kind == "csv" else "\t", **options).csv(path)
    if kind in ("json", "jsonl", "ndjson"):
        return spark.read.options(**options).json(path)
    if kind in ("parquet", "orc"):
        return spark.read.options(**options).format(kind).load(path)
    import pandas as pd

    readers = {"xlsx": pd.read_excel, "xls": pd.read_excel, "feather": pd.read_feather, "ft": pd.read_feather, "pkl": pd.read_pickle, "pickle": pd.read_pickle, "h5": pd.read_hdf, "hdf": pd.read_hdf}
    if kind not in readers:
        raise ValueError(f"unknown kind of table: {path}")
    return spark.createDataFrame(readers[kind](path, **options))


def annotated_path(path: str) -> str:
    """The strongest annotated copy beside a table, or the table itself."""
    stem = path.rsplit(".", 1)[0]
    return next((stem + e for e in ANNOTATED if os.path.exists(stem + e)), path)


def layered(layers: list[DataFrame], key: str = "id") -> DataFrame:
    """Layers, the strongest first, as one row for each key: of every column the strongest non-empty value."""
    ranked = [df.withColumn("_layer", F.lit(k)) for k, df in enumerate(layers)]
    union = ranked[0]
    for df in ranked[1:]:
        union = union.unionByName(df, allowMissingColumns=True)
    value = lambda c: F.min_by(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.when(F.trim(F.col(c).cast("string")) != "", F.col("_layer")))
    return union.groupBy(key).agg(*[value(c).alias(c) for c in union.columns if c not in (key, "_layer")])


def clean_metadata(df: DataFrame, year: str = "year") -> DataFrame:
    """Empty strings as nulls; years as integers, with the original beside where it differs."""
    out = df.select(*[F.when(~F.trim(F.col(c)).isin("", "nan", "None"), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    if year in df.columns:
        number = F.col(year).cast("string").try_cast("double").cast("int")
        out = out.withColumn(f"{year}_orig", F.when(~number.cast("string").eqNullSafe(F.col(year).cast("string")), F.col(year).cast("string"))).withColumn(year, number)
    return out


def json_walk(spark: SparkSession, folder: str, name: str = "meta.json") -> DataFrame:
    """Every such file below a folder; id is its folder."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).json(folder)
    return found.withColumn("id", F.regexp_extract("_metadata.file_path", rf"([^/]+)/{name}$", 1))


def texts(spark: SparkSession, folder: str, extension: str = "txt") -> DataFrame:
    """id and text of every file of an extension below a folder; none if there is no such folder."""
    try:
        found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").text(folder, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "id string, text string")
    return found.select(F.regexp_extract("_metadata.file_path", rf"([^/]+)\.{extension}$", 1).alias("id"), F.col("value").alias("text"))


def xml_texts(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, "xml").withColumn("text", udfs.xml_to_text("text"))


def texts_or_xml(spark: SparkSession, ids: DataFrame, txt: str, xml: str) -> DataFrame:
    """The plain text of each id, else its XML's text, else ''."""
    plain, marked = texts(spark, txt), xml_texts(spark, xml).withColumnRenamed("text", "_xml")
    return ids.join(plain, "id", "left").join(marked, "id", "left").withColumn("text", F.coalesce("text", "_xml", F.lit(""))).drop("_xml")


def frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """id, word, count of {word: count} files (plain or gzipped); an unreadable file has no rows."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").text(folder, wholetext=True)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)\.json(\.gz)?$", 1)
    return raw.select(name.alias("id"), F.explode(F.from_json("value", "map<string,bigint>")).alias("word", "count"))


def tsv_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """word, count of lines 'word<TAB>count', summed."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    return raw.select(F.lower(F.col("p")[0]).alias("word"), F.get("p", F.lit(1)).try_cast("bigint").alias("n")).where("n is not null").groupBy("word").agg(F.sum("n").alias("count"))


def spelling_map(spark: SparkSession, path: str) -> DataFrame:
    """old, new of lines 'old<TAB>new'."""
    return spark.read.options(sep="\t").schema("old string, new string").csv(path).where("new is not null")


def marc_json(spark: SparkSession, path: str) -> DataFrame:
    """Flat records of JSON lines with fields: [{tag, ind1, ind2, subfields: [{code, value}]}]."""
    kind = "id string, fields array<struct<tag:string,subfields:array<struct<code:string,value:string>>>>"
    raw = spark.read.schema(kind).json(path)

    def value(tag: str, code: str):
        found = F.flatten(F.transform(F.filter("fields", lambda f: f["tag"] == tag), lambda f: F.filter(f["subfields"], lambda s: s["code"] == code)))
        return F.nullif(F.array_join(F.transform(found, lambda s: s["value"]), " | "), F.lit(""))

    date = F.nullif(F.regexp_extract(value("260", "c"), r"(\d{4})", 1), F.lit("")).cast("int")
    return raw.select("id", value("100", "a").alias("author"), value("245", "a").alias("title"), value("260", "b").alias("publisher"), F.when(date.between(1000, 2100), date).alias("year"), value("300", "a").alias("extent"), value("300", "c").alias("format"), value("650", "a").alias("subjects"), value("655", "a").alias("forms"))


def marc_xml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "record").load(path)


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """The last value of each key of a folder of Parquet rows (key, value, at)."""
    rows = spark.read.parquet(path)
    last = Window.partitionBy("key").orderBy(F.col("at").desc())
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1 and value is not null").select("key", "value")


#: Subfields of a holding, by column. Fixed values.
HOLDING = {"institution_code": "a", "institution_name": "b", "sublocation": "c", "former_shelfmark": "d", "location": "e", "shelfmark": "j", "provenance": "p", "note": "q", "record_id": "r", "verification": "x", "public_note": "z"}


def marc_holdings(spark: SparkSession, path: str) -> DataFrame:
    """estc_id, system_number, leader and a holding's columns: a row for each field 852 of records in JSON lines, whose
    fields are [{tag: value or {subfields: [{code: value}]}}]."""
    raw = spark.read.schema("leader string, fields array<map<string,string>>").json(path)
    control = lambda tag: F.get(F.filter("fields", lambda f: F.map_contains_key(f, tag)), F.lit(0))[tag]
    held = F.transform(F.filter("fields", lambda f: F.map_contains_key(f, "852")), lambda f: F.from_json(f["852"], "subfields array<map<string,string>>")["subfields"])
    rows = raw.select(control("001").alias("estc_id"), control("009").alias("system_number"), "leader", F.explode(held).alias("_s"))
    value = lambda code: F.get(F.filter("_s", lambda s: F.map_contains_key(s, code)), F.lit(0))[code]
    return rows.select("estc_id", "system_number", "leader", *[value(code).alias(c) for c, code in HOLDING.items()])


def word_map(spark: SparkSession, path: str, column: str = "pos") -> DataFrame:
    """word and a value, of JSON lines {word: value}."""
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("word", column))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path: every file below a folder, relative to it. Names only; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return found.select(F.regexp_extract("path", r"\Q" + folder.rstrip("/").removeprefix("file://") + r"\E/(.*)$", 1).alias("path"))


def gexf_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight of a graph file that sinks.write_gexf wrote, or another with an edge a line."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"<edge\s"))
    value = lambda name: unescaped(F.regexp_extract("value", rf'\b{name}="([^"]*)"', 1))
    return lines.select(value("source").alias("src"), value("target").alias("dst"), value("weight").try_cast("double").alias("weight"))
