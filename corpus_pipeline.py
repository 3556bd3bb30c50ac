"""The training-data pipeline: documents through toxicity, near-duplicate, secret and mixing stages into packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents, with their own values whatever they are called; only `text` and
`n_chars` change, where a stage changes texts. Null texts are kept until the mix, which takes nothing of them; rows without
a doc_id are kept by all stages; an empty table stays empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quire.llm import jaccard, mixing, packing, secrets, toxicity
from quire.llm.common import aside, dimension, materialize, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    named, back = aside(docs, "score", "predicted")
    return back(toxicity.score(named, toxicity.train_from(spark, sf_dir, docs)).where("predicted = 0"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; of rows that share doc_id and text
    the first by their other columns."""
    found = materialize(jaccard.jaccard_components(docs.select("doc_id", "text")), "components")
    # A row without an id is in no group
    goes = found.where("doc_id <> component_id").select("doc_id").distinct()
    again = materialize(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    kept = docs.join(dimension(materialize(goes, "copies")), "doc_id", "left_anti").select(*docs.columns)
    if not again.limit(1).count():
        return kept
    repeated = kept.join(dimension(again), "doc_id", "left_semi").select(*docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text") and not isinstance(docs.schema[c].dataType, MapType)]
    maps = [c for c in docs.columns if isinstance(docs.schema[c].dataType, MapType)]
    row = "_"
    while row in docs.columns:
        row += "_"
    # Copies of a row meet in partial aggregates, not in one task's sort
    once = repeated.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias(row), *others)).alias(row), *[F.first(c).alias(c) for c in maps])
    once = once.select(*[F.col(c) if c in ("doc_id", "text", *maps) else F.col(f"`{row}`.`{c}`").alias(c) for c in docs.columns])
    return kept.join(dimension(again), "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; what the forest calls a secret is replaced by a mark in their texts."""
    return secrets.redacted(docs, secrets.train(secrets.labelled_findings(spark), secrets.corpus_words(docs)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or cut to a window of words, as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences with their ids: a sequence is its pieces' ids by offset (packing.sequences). A
    document that the mix repeats gives pieces for each of its rows; sequence_id and offset tell them apart."""
    return packing.pack(docs, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("secrets", hide_secrets), ("mixing", mix), ("packing", pack)]

#: Stages learn models and pack by heaps; the pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
