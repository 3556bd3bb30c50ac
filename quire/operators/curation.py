"""People's edits over matched and annotated records: links set and cut, annotations written one by one or in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANUAL = "manual"


def link(pairs: DataFrame, added: DataFrame) -> DataFrame:
    """pairs (a, b, similarity, tier) with people's links (a, b, either way round): tier manual, over what there was."""
    new = added.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    return pairs.join(new, ["a", "b"], "left_anti").unionByName(new.select("a", "b", F.lit(1.0).alias("similarity"), F.lit(MANUAL).alias("tier")))


def unlink(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """pairs without those that people cut (a, b, either way round)."""
    gone = cut.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(gone, ["a", "b"], "left_anti")


def annotate(annotations: DataFrame, new: DataFrame) -> DataFrame:
    """annotations: _id, source, col, val, seq. A later annotation of the same text, source and column replaces the
    earlier; a null value takes it away."""
    both = annotations.unionByName(new)
    last = both.groupBy("_id", "source", "col").agg(F.max_by(F.struct("val", "seq"), F.struct("seq", F.coalesce("val", F.lit("")))).alias("m"))
    return last.select("_id", "source", "col", "m.val", "m.seq").where("val is not null")


def bulk(texts: DataFrame, chosen: Column, source: str, col: str, val: str, seq: int) -> DataFrame:
    """An annotation of every text that a predicate chooses."""
    return texts.where(chosen).select("_id", F.lit(source).alias("source"), F.lit(col).alias("col"), F.lit(val).alias("val"), F.lit(seq).cast("long").alias("seq"))


def annotation_stats(annotations: DataFrame) -> DataFrame:
    """source, col, val: annotations and texts."""
    return annotations.groupBy("source", "col", "val").agg(F.count("*").alias("n"), F.count_distinct("_id").alias("n_texts"))


def linkage_between(left: DataFrame, right: DataFrame, block: str, compare: list[str], least: float = 0.9) -> DataFrame:
    """Pairs of a row of one table and one of another in the same block whose strings are all alike by edit distance."""
    a, b = left.alias("a"), right.alias("b")
    on = F.col(f"a.{block}") == F.col(f"b.{block}")
    for c in compare:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        on = on & (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)) >= least)
    return a.join(b, on).select(F.col("a._id").alias("a"), F.col("b._id").alias("b"))


def minhash(words: Column, n: int = 8) -> Column:
    """The smallest of each of n hashes (60 bits of MD5 over a number and a word) of a set of words; null for none."""

    def hashed(k: int):
        return lambda w: F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), w).cast("binary")), 1, 15), 16, 10).cast("long")

    return F.array(*[F.array_min(F.transform(words, hashed(k))) for k in range(n)])


def minhash_similarity(a: Column, b: Column) -> Column:
    """The share of places at which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
