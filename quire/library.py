"""A library: texts, word index, matches and groups as Parquet folders, and the questions asked of them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import explore as X
from quire.operators import matching as M
from quire.operators import words as W
from quire.sources import corpora as C
from quire.sources import sinks as K


class Library:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def rebuild(self, corpora: list[C.Corpus]) -> dict[str, str]:
        """Ingests corpora, each over what it had; returns why some failed."""
        rows, failed = C.union(self.spark, corpora)
        if rows is not None:
            K.replace_corpus(rows.withColumn("ingested_at", F.lit(time.time())), f"{self.folder}/texts")
        return failed

    def index(self, corpora: list[C.Corpus], from_texts: bool = True) -> None:
        """Counts the words of corpora, each over what it had, with the year and genre of each text."""
        keys = self.table("texts").select("_id", "year", "genre")
        for c in corpora:
            K.replace_corpus(c.word_index(self.spark, from_texts).drop("id").join(keys, "_id"), f"{self.folder}/word_index")

    def id_links(self, corpora: list[C.Corpus]) -> list[DataFrame]:
        """Pairs that corpora declare by match_links {other: (my column, its column)}; `id` or a column of the metadata."""
        texts, out = self.table("texts"), []
        value = lambda c: F.col("id") if c == "id" else F.from_json("meta", "map<string,string>")[c]
        for c in corpora:
            for other, (mine, theirs) in c.match_links.items():
                own = texts.where(F.col("corpus") == c.name).select("_id", value(mine).alias("key"))
                out.append(M.id_link(own, texts.where(F.col("corpus") == other).select("_id", value(theirs).alias("key"))))
        return out

    def match(self, corpora: tuple[str, ...] = (), fuzzy: bool = False, declared: list[C.Corpus] | None = None) -> None:
        """Matches all records, or some corpora's, tier by tier, and groups them. declared: corpora whose id links come
        first."""
        rows = self.table("texts") if not corpora else self.table("texts").where(F.col("corpus").isin(*corpora))
        tiers = [*self.id_links(declared or []), M.exact(rows), M.exact_year(rows), M.containment(rows), M.containment_year(rows)] + ([M.fuzzy(rows)] if fuzzy else [])
        M.first_tier(*tiers).write.mode("overwrite").parquet(f"{self.folder}/matches")
        M.groups(self.table("matches")).write.mode("overwrite").parquet(f"{self.folder}/groups")

    def texts(self, dedup: str | None = None, **where) -> DataFrame:
        """Texts of a genre, corpora, years or sources; dedup: 'rank' or 'oldest' of each group among them."""
        rows = self.table("texts").where(X.where(**where))
        if dedup:
            rows = rows.join(self.table("groups"), "_id", "left")
            order = [F.col("rank")] if dedup == "rank" else [F.col("year").asc_nulls_last(), F.col("rank")]
            rows = W.kept_by(rows, "group", [*order, F.col("_id")]).drop("group", "rank")
        return X.by_order(rows)

    def get(self, id_: str) -> dict | None:
        """A text's columns and metadata that aren't null, the former over the latter."""
        row = self.table("texts").where(F.col("_id") == id_).withColumn("meta", F.from_json("meta", "map<string,string>")).first()
        if row is None:
            return None
        d = row.asDict()
        return {k: v for k, v in {**(d.pop("meta") or {}), **d}.items() if v is not None}

    def ngram(self, words: list[str], n: int = 10, dedup: str | None = None, by: tuple = (), per_million: bool = True, **where) -> DataFrame:
        index = self.table("word_index").where(X.where(**where))
        if dedup:
            index = index.join(self.texts(dedup, **where).select("_id"), "_id", "left_semi")
        return W.series(index, words, n, by, per_million)

    def info(self) -> DataFrame:
        return X.overview(self.table("texts"))

    def matches(self, title: str) -> DataFrame:
        return M.found(self.table("groups"), self.table("texts").select("_id", "title", "year"), title)

    def query(self, sql: str) -> DataFrame:
        """SQL over the library's tables, by their names."""
        for name in ("texts", "word_index", "matches", "groups"):
            try:
                self.table(name).createOrReplaceTempView(name)
            except Exception:  # noqa: BLE001 - not built yet
                continue
        return self.spark.sql(sql)
