"""Corpora: where a collection's tables and texts lie, how its rows are shaped, and what it links to."""

from __future__ import annotations

import configparser
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import ingest as I
from quire.operators import links as L

from . import readers as R
from . import tables as S


@dataclass
class Corpus:
    """A collection. links: {other corpus: (my column, its column)}; shape: a function over the metadata table;
    link_keys: column functions applied to my column before it is compared."""

    name: str
    root: str
    metadata: str = "metadata.csv"
    texts: str = "txt"
    xml: str = "xml"
    frequencies: str = "freqs"
    links: dict[str, tuple[str, str]] = field(default_factory=dict)
    match_links: dict[str, tuple[str, str]] = field(default_factory=dict)
    link_keys: dict[str, Callable] = field(default_factory=dict)
    shape: Callable[[DataFrame], DataFrame] | None = None

    def meta(self, spark: SparkSession) -> DataFrame:
        """The metadata, cleaned, shaped and without rows marked as excluded."""
        df = R.clean_metadata(R.metadata(spark, R.annotated_path(f"{self.root}/{self.metadata}")))
        df = df if self.shape is None else df.transform(self.shape)
        if "exclude" in df.columns:
            df = df.where(F.col("exclude").isNull() | F.col("exclude").isin("", "False", "false"))
        return df

    def ingested(self, spark: SparkSession) -> DataFrame:
        return I.ingest(self.meta(spark), self.name)

    def plain_texts(self, spark: SparkSession) -> DataFrame:
        """_id, corpus, id, text of every text of the metadata; XML where there is no plain text."""
        ids = self.meta(spark).select("id").distinct()
        rows = R.texts_or_xml(spark, ids, f"{self.root}/{self.texts}", f"{self.root}/{self.xml}")
        return rows.select(I.address(F.lit(self.name), F.col("id")).alias("_id"), F.lit(self.name).alias("corpus"), "id", "text")

    def word_index(self, spark: SparkSession, from_texts: bool = True) -> DataFrame:
        if from_texts:
            return S.word_index(self.plain_texts(spark))
        rows = R.frequencies(spark, f"{self.root}/{self.frequencies}")
        return rows.select(I.address(F.lit(self.name), F.col("id")).alias("_id"), F.lit(self.name).alias("corpus"), "id", "word", "count")

    def linked(self, spark: SparkSession, others: dict[str, Corpus]) -> DataFrame:
        """The metadata with the columns of what it links to, prefixed."""
        df = self.meta(spark)
        for target, (mine, theirs) in self.links.items():
            if target in others:
                df = L.linked(df, others[target].meta(spark), mine, theirs, target, self.link_keys.get(target))
        return df

    def linking(self, spark: SparkSession, other: Corpus, ids: DataFrame) -> DataFrame:
        """The rows of another corpus that link to some of my ids."""
        mine, theirs = other.links[self.name]
        keys = self.meta(spark).join(ids, "id", "left_semi").select(F.col(theirs).alias(mine))
        return other.meta(spark).join(keys, mine, "left_semi")


def manifest(*paths: str) -> dict[str, dict[str, str]]:
    """Sections of manifest files; a later file's keys override an earlier one's."""
    parser = configparser.ConfigParser()
    parser.read(paths)
    return {name: dict(parser[name]) for name in parser.sections()}


def registered(*paths: str, kinds: dict[str, Callable[..., Corpus]] | None = None) -> dict[str, Corpus]:
    """Corpora by id, from manifests whose sections have `root` and may name files, links ('other:mine=theirs, ...') and a
    kind of the caller's."""
    out = {}
    for name, keys in manifest(*paths).items():
        pairs = [p.strip().split(":") for p in keys.get("links", "").split(",") if p.strip()]
        links = {target: tuple(c.strip() for c in columns.split("=")) for target, columns in pairs}
        files = {k: keys[k] for k in ("metadata", "texts", "xml", "frequencies") if k in keys}
        make = (kinds or {}).get(keys.get("kind", ""), Corpus)
        out[keys.get("id", name)] = make(name=keys.get("id", name), root=keys["root"], links=links, **files)
    return out


def union(spark: SparkSession, corpora: list[Corpus]) -> tuple[DataFrame | None, dict[str, str]]:
    """The ingested rows of all corpora that could be read, and why the others couldn't."""
    found, failed = None, {}
    for c in corpora:
        try:
            df = c.ingested(spark)
        except Exception as e:  # noqa: BLE001 - one corpus's broken files don't stop the others
            failed[c.name] = str(e).splitlines()[0]
            continue
        found = df if found is None else found.unionByName(df, allowMissingColumns=True)
    return found, failed
