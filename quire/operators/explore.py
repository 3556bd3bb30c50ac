"""Aggregates, crosstabs, timelines, pages and searches over texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import vocabulary as V


def where(genre=None, corpora=None, year_min=None, year_max=None, sources: list[dict] | None = None, also: Column | None = None) -> Column:
    """All given predicates; sources: any of several sets of them, whose keys may end in _min or _max."""
    out = F.lit(True)
    for name, value in (("genre", genre), ("corpus", corpora)):
        if value is not None:
            out = out & F.col(name).isin(*([value] if isinstance(value, str) else value))
    if year_min is not None:
        out = out & (F.col("year") >= year_min)
    if year_max is not None:
        out = out & (F.col("year") <= year_max)
    if sources:
        any_of = F.lit(False)
        for s in sources:
            one = F.lit(True)
            for k, v in s.items():
                if k.endswith("_min"):
                    one = one & (F.col(k[:-4]) >= v)
                elif k.endswith("_max"):
                    one = one & (F.col(k[:-4]) <= v)
                else:
                    one = one & F.col(k).isin(*(v if isinstance(v, (list, tuple, set)) else [v]))
            any_of = any_of | one
        out = out & any_of
    return out if also is None else out & also


def by_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in ("year", "corpus", "_id")])


def corpora(texts: DataFrame) -> DataFrame:
    return texts.groupBy("corpus").agg(F.count("*").alias("n"), F.min("year").alias("year_min"), F.max("year").alias("year_max"))


def coverage(texts: DataFrame, columns: list[str]) -> DataFrame:
    """Per corpus the percentage of texts that have each column."""
    return texts.groupBy("corpus").agg(F.count("*").alias("n"), *[F.round(100 * F.count(c) / F.count("*"), 1).alias(f"{c}_pct") for c in columns])


def genre_top(texts: DataFrame, n: int) -> DataFrame:
    counts = texts.groupBy("corpus", "genre").agg(F.count("*").alias("n"))
    first = Window.partitionBy("corpus").orderBy(F.col("n").desc(), F.col("genre").asc_nulls_last())
    return counts.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n).withColumn("in_vocabulary", F.coalesce(F.col("genre").isin(*V.GENRES), F.lit(False)))


def crosstab(texts: DataFrame) -> DataFrame:
    """Genre by corpus with totals, long: TOTAL stands for all."""
    g = F.when(F.col("genre").isin(*V.GENRES), F.col("genre")).otherwise("Other")
    cube = texts.withColumn("genre", g).cube("corpus", "genre").agg(F.count("*").alias("n"))
    return cube.select(F.coalesce("corpus", F.lit("TOTAL")).alias("corpus"), F.coalesce("genre", F.lit("TOTAL")).alias("genre"), "n")


def heatmap(texts: DataFrame, n: int = 100) -> DataFrame:
    return texts.where("year is not null").groupBy(T.year_bin("year", n).alias("period"), "genre").agg(F.count("*").alias("n"))


def timeline(texts: DataFrame, values: list[str], n: int = 10) -> DataFrame:
    wide = texts.where("year is not null").groupBy(T.year_bin("year", n).alias("period")).pivot("genre", values).count()
    return wide.na.fill(0)


def overview(texts: DataFrame, latest: int = 2030) -> DataFrame:
    return texts.groupBy("corpus").agg(F.count("*").alias("n"), F.min("year").alias("year_min"), F.max(F.when(F.col("year") <= latest, F.col("year"))).alias("year_max"), F.count_distinct("genre").alias("n_genres"), F.count_distinct("author").alias("n_authors"))


def global_stats(texts: DataFrame) -> DataFrame:
    return texts.agg(F.count("*").alias("n_texts"), F.count_distinct("corpus").alias("n_corpora"), F.min("year").alias("year_min"), F.max("year").alias("year_max"))


def top_authors(texts: DataFrame, n: int) -> DataFrame:
    a = F.initcap(T.normalize_author("author"))
    return texts.groupBy(a.alias("author")).agg(F.count("*").alias("n")).where("author is not null").orderBy(F.col("n").desc(), "author").limit(n)


def page(texts: DataFrame, offset: int, size: int, title: str | None = None, order: list[str] | None = None) -> DataFrame:
    """A page of the texts whose title or author holds a string."""
    out = texts if title is None else texts.where(F.col("title").ilike(f"%{title}%") | F.col("author").ilike(f"%{title}%"))
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in order or ["year", "corpus", "_id"]]).offset(offset).limit(size)


def prefixed_key(meta: Column, key: str) -> Column:
    """The first non-empty value of the keys that begin with one."""
    found = F.map_filter(meta, lambda k, v: k.startswith(key) & (F.coalesce(v, F.lit("")) != ""))
    return F.get(F.map_values(F.map_from_entries(F.array_sort(F.map_entries(found)))), F.lit(0))


def ranked_key(values: list[Column]) -> Column:
    """The first of several columns that isn't empty; of alternatives parted by bars the first."""
    return F.coalesce(*[F.nullif(F.trim(F.substring_index(v, "|", 1)), F.lit("")) for v in values])


def trusted(texts: DataFrame, sources: tuple[str, ...], corpora: tuple[str, ...], before: int = 1801) -> DataFrame:
    """Texts whose genre has a trusted source or corpus, if they are from before a year; later and undated ones stay."""
    return texts.where(~F.coalesce(F.col("year") < before, F.lit(False)) | F.coalesce(F.col("genre_source").isin(*sources), F.lit(False)) | F.col("corpus").isin(*corpora))


def chosen(corpora: dict[str, DataFrame], query: str, separator: str = ";") -> DataFrame:
    """Texts by `corpus|id` or `corpus|condition`, several joined by a separator."""
    parts = [part.strip().split("|", 1) for part in query.split(separator) if "|" in part]
    if not parts:
        raise ValueError("a query names a corpus: corpus|id or corpus|condition")
    one = lambda name, q: corpora[name].where(F.expr(q) if any(c in q for c in "=<>\"'") else F.col("id") == q)
    return reduce(lambda a, b: a.unionByName(b), [one(name, q) for name, q in parts])
