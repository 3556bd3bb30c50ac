"""Ingest of metadata into the texts table, and the edits of that table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import vocabulary as V

from .ordering import placed


def ingest(rows: DataFrame, corpus: str | None = None, order: list | None = None) -> DataFrame:
    """Metadata rows as texts: ids required and unique (the first stays), years parsed, keys normalised, further columns
    packed as JSON. corpus: a name, or None to take the column."""
    of = F.lit(corpus) if corpus else F.col("corpus")
    out = rows.withColumn("corpus", of).withColumn("id", F.trim(F.col("id").cast("string"))).where("id is not null and id <> ''")
    first = Window.partitionBy("corpus", "id").orderBy(*(order or [F.monotonically_increasing_id()]))
    out = out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    for c in ("title", "author", "year", "genre", "genre_raw"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    tail = [c for c in out.columns if c not in V.CORE_COLUMNS and not c.startswith("_")]
    blank = lambda c: F.col(c).cast("string").isin("", "nan", "None", "[]")
    packed = F.to_json(F.struct(*[F.when(~blank(c), F.col(c).cast("string")).alias(c) for c in tail])) if tail else F.lit("{}")
    return out.select(
        address(F.col("corpus"), F.col("id")).alias("_id"), "corpus", "id", "title", "author",
        T.parse_year("year").alias("year"), "genre", T.normalize_genre_raw("genre_raw").alias("genre_raw"),
        T.normalize_title("title").alias("title_norm"), T.normalize_author("author").alias("author_norm"), packed.alias("meta"),
    )


def address(corpus, id_):
    return F.concat(F.lit("_"), corpus, F.lit("/"), id_)


def parsed_address(column: str = "_id"):
    """corpus and id of an address; ids may hold slashes."""
    return F.regexp_extract(column, "^_([^/]*)/", 1).alias("corpus"), F.regexp_extract(column, "^_[^/]*/(.*)$", 1).alias("id")


def unpacked(df: DataFrame, keys: list[str], column: str = "meta") -> DataFrame:
    meta = F.from_json(column, "map<string,string>")
    return df.withColumn("_m", meta).select("*", *[F.col("_m")[k].alias(k) for k in keys]).drop("_m")


def drop_corpus(df: DataFrame, corpus: str, *columns: str) -> DataFrame:
    """Rows without those of a corpus, by the addresses in the columns."""
    prefix = f"_{corpus}/"
    keep = F.lit(True)
    for c in columns or ("_id",):
        keep = keep & ~F.col(c).startswith(prefix)
    return df.where(keep)


def corpus_info(texts: DataFrame, at) -> DataFrame:
    return texts.groupBy("corpus").agg(F.count("*").alias("n_texts")).withColumn("ingested_at", F.lit(at).cast("double"))


def only_new(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return rows.join(done, list(keys), "left_anti")


def forced_ids(df: DataFrame, order: list) -> DataFrame:
    """Missing ids as X0001 and so on, by place; rows that have an id stay where they are."""
    missing = F.coalesce(F.col("id"), F.lit("")) == ""
    given = placed(df.where(missing), order, "_place").withColumn("id", F.format_string("X%04d", "_place"))
    return df.where(~missing).unionByName(given.select(*df.columns))


def versioned_ids(df: DataFrame, order: list) -> DataFrame:
    """Repeated ids as id, id/v2, id/v3 ..."""
    n = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    return df.withColumn("id", F.when(n > 1, F.concat_ws("/v", "id", n.cast("string"))).otherwise(F.col("id")))
