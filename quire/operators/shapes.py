"""Tables of other shapes: nested to flat, metadata as rows, one column a key, counts of tokens with their places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ordering import placed

#: Between a key and the corpus that it comes from.
SOURCE = "__"
#: Keys that may become columns, and rows of a download.
KEYS = 10_000
ROWS = 100_000


def flattened(df: DataFrame, separator: str = "_") -> DataFrame:
    """Fields of structs as columns named by their last parent and themselves; of equal names the last stays."""

    def leaves(schema: StructType, at: Column | None, parent: str):
        for f in schema.fields:
            c = F.col(f"`{f.name}`") if at is None else at.getField(f.name)
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, c, f.name)
            else:
                yield (parent + separator + f.name if parent else f.name), c

    return df.select(*[c.alias(name) for name, c in dict(leaves(df.schema, None, "")).items()])


def grouped_rows(df: DataFrame, rows: str, key: str, column: str = "group") -> DataFrame:
    """A row for each struct of an array, with its group's key."""
    return df.select(F.col(key).alias(column), F.explode(rows).alias("_r")).select("_r.*", column)


def triples(df: DataFrame, id_: str, meta: str, prefix: str = "") -> DataFrame:
    """source, key, value: distinct entries of a map whose key begins with a prefix."""
    return df.select(F.col(id_).alias("source"), F.explode(meta).alias("key", "value")).where(F.col("key").startswith(prefix)).distinct()


def by_source(df: DataFrame, id_: str, meta: str, own: Column) -> DataFrame:
    """_id, corpus, key, value: entries named key__corpus belong to that corpus, others to the text's own."""
    rows = df.select(F.col(id_).alias("_id"), own.alias("_own"), F.explode(meta).alias("_k", "value"))
    at = F.instr("_k", SOURCE)
    key = F.when(at > 0, F.expr(f"substring(_k, 1, instr(_k, '{SOURCE}') - 1)")).otherwise(F.col("_k"))
    corpus = F.when(at > 0, F.expr(f"substring(_k, instr(_k, '{SOURCE}') + {len(SOURCE)})")).otherwise(F.col("_own"))
    return rows.select("_id", corpus.alias("corpus"), key.alias("key"), "value")


def source_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("_id", "corpus").agg(F.count("*").alias("n"))


def widened(df: DataFrame, meta: str = "meta") -> DataFrame:
    """The keys of a JSON column as columns, but for those that the table has already. More than KEYS keys are refused."""
    parsed = df.withColumn("_m", F.from_json(meta, "map<string,string>"))
    found = [r[0] for r in parsed.select(F.explode(F.map_keys("_m")).alias("k")).distinct().limit(KEYS + 1).collect()]
    if len(found) > KEYS:
        raise ValueError(f"more than {KEYS} keys in {meta}")
    old = [c for c in df.columns if c != meta]
    return parsed.select(*old, *[F.col("_m")[k].alias(k) for k in sorted(found) if k not in old])


def download(df: DataFrame, meta: str = "meta", rows: int = ROWS) -> DataFrame:
    """The first rows by year, title and _id, with their metadata as columns."""
    return widened(df.orderBy(F.col("year").asc_nulls_last(), "title", "_id").limit(rows), meta)


def character_tokens(df: DataFrame, columns: list[str], id_of) -> DataFrame:
    """Tokens of some columns with their counts, their ids and their places, the most frequent first."""
    each = reduce(lambda a, b: a.union(b), [df.select(F.col(c).alias("char_tok")) for c in columns])
    counts = each.where("coalesce(char_tok, '') <> ''").groupBy("char_tok").agg(F.count("*").alias("char_tok_count"))
    return placed(counts.withColumn("char_id", id_of("char_tok")), [F.col("char_tok_count").desc(), "char_tok"], "char_tok_i")
