"""Mixing sources to target weights by capped water-filling [native: DataFrame and SQL functions only].

Every source gets `weight / sum of weights` of a total. A source whose share exceeds `max_epochs` times its size is
clamped there and its excess goes to the others in proportion to their weights, until none exceeds its cap. The level
this ends at has a closed form: order sources by cap / weight; the clamped ones are a prefix of that order, so running
sums of caps and weights give the level of every prefix, and the first source above its level ends the prefix.

A document then takes `target / size` of itself: whole repetitions, and of one more a seeded window of words (the
fractional repetition), rounded up or down by a seeded draw so that the words of a source add up to its target. A window
is a stretch of the text as it stands: it doesn't wrap round, and keeps the blanks and line breaks between its words.

The table of sources is one row a source after a partial aggregation. Their order, and running sums over it, are made in
two steps: inside ranges of the order, and over one row a range; so sources may be as many as documents. Documents never
meet in a group.

Nulls: a null text has size 0 and takes nothing; a null source is a source of its own, last in the order. A null doc_id
draws like the empty text. Repeated rows are separate documents with the same draw. An empty table gives an empty result.
Columns of documents other than those named are passed through `mix_sources` untouched; the columns it adds replace
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, aside, dimension, fresh, materialize, read

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
ADDED = ("size", "source_size", "target", "taken", "whole", "part", "part_start")


def n_words(text: str) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    parts = F.size(F.split(F.col(text), SPACE_CLASS))
    return F.when(F.col(text).isNull() | (F.col(text) == ""), 0).otherwise(parts - F.col(text).rlike(r"^[\x20\x09-\x0D]").cast("int") - F.col(text).rlike(r"[\x20\x09-\x0D]\z").cast("int")).cast("long").alias("size")


def placed(df: DataFrame, *order: Column, **sums: str) -> DataFrame:
    """Adds the place of each row in an order, from 1, and for each name=column the sum of that column over the rows
    before it. Ranges of the order are sorted apart; only their totals, a row a range, meet in one task."""
    parts = materialize(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("range_").orderBy(*order)
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    total = parts.groupBy("range_").agg(F.count("*").alias("n_"), *[F.sum(c).alias(f"{k}_") for k, c in sums.items()])
    total = total.select("range_", *[F.coalesce(F.sum(f"{k}_").over(before), F.lit(0)).alias(f"{k}_") for k in ("n", *sums)])
    rows = parts.join(dimension(total), "range_")
    own = {k: F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col(f"{k}_") for k, c in sums.items()}
    return rows.select(*df.columns, (F.row_number().over(inside) + F.col("n_")).alias("place"), *[c.cast("double").alias(k) for k, c in own.items()])


def water_fill(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: source, source_size (one row a source). Adds target; weights repeat over the sources by code point, null last."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = placed(sizes.select("source", "source_size"), F.col("source").asc_nulls_last())
    ranked = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight")).withColumnRenamed("place", "rank")
    filled = materialize(placed(ranked, F.col("ratio").asc(), F.col("rank").asc(), caps_before="cap", weights_before="weight"), "filled")
    every = filled.agg((F.sum("source_size") * float(share)).alias("total"), F.sum("weight").alias("all_weight"))
    here = (F.col("total") - F.col("caps_before")) / (F.col("all_weight") - F.col("weights_before"))
    filled = filled.join(F.broadcast(every)).withColumn("here", here)  # one row
    level = filled.agg(F.max(F.when(F.col("ratio") > F.col("here"), F.col("here"))).alias("level"))
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return filled.join(F.broadcast(level)).select("source", "source_size", target.alias("target"))


def draw(doc_id: str, seed: str) -> Column:
    """A double in [0, 1), the same for the same id and seed: the first 13 hex digits of an MD5."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, text: str = "text", sized: DataFrame | None = None) -> DataFrame:
    """docs: doc_id, source and text. Adds size, source_size, target, taken, whole (repetitions of all words),
    part (words of the last, partial one) and part_start (its first word, counted from 0)."""
    sized = docs.drop(*ADDED).withColumn("size", n_words(text)) if sized is None else sized
    of = fresh(sized, "_of")
    by_source = materialize(water_fill(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs), "sources").withColumnRenamed("source", of)
    joined = sized.join(dimension(by_source), sized["source"].eqNullSafe(by_source[of]), "left").drop(of)
    want = F.when(F.col("source_size") > 0, F.col("size") * F.col("target") / F.col("source_size")).otherwise(0.0)
    taken = F.least(F.floor(want + draw("doc_id", seed)), F.col("size") * max_epochs).cast("long")
    return (
        joined.withColumn("taken", taken)
        .withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("long"))
        .withColumn("part", F.col("taken") - F.col("whole") * F.col("size"))
        .withColumn("part_start", F.floor(draw("doc_id", seed + ":window") * (F.col("size") - F.col("part") + 1)).cast("long"))
    )


def mixed_documents(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The mix itself, with the columns and values of docs: each document as often as it is taken, its partial repetition
    as the window of its text. n_chars, where there, is that of the row's text."""
    named, back = aside(docs, *ADDED)
    mixed = mix_sources(named, text=text, **how)
    copy = fresh(mixed, "_copy")
    # Words, each with the blanks after it; blanks before the first word are a piece of their own
    pieces = F.split(F.col(text), rf"(?<={SPACE_CLASS[:-1]})(?=[^{SPACE_CLASS[1:-1]})")
    first = F.col("part_start") + 1 + F.col(text).rlike(rf"^{SPACE_CLASS[:-1]}").cast("int")
    window = F.regexp_replace(F.array_join(F.slice(pieces, first.cast("int"), F.col("part").cast("int")), ""), rf"{SPACE_CLASS}\z", "")
    copies = F.concat(F.sequence(F.lit(1), F.lit(int(how.get("max_epochs", MAX_EPOCHS)))), F.array(F.lit(0)))
    out = mixed.withColumn(copy, F.explode(F.filter(copies, lambda k: ((k > 0) & (k <= F.col("whole"))) | ((k == 0) & (F.col("part") > 0)))))
    out = out.withColumn(text, F.when(F.col(copy) == 0, window).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return back(out)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", n_words("text")), "sizes")
    return mix_sources(docs, sized=sized).select("doc_id", "size", "source_size", "target", "taken", "whole", "part", "part_start")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS rank FROM sums),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked),
running AS (
  SELECT *, cap / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER w, 0) AS caps_before, coalesce(sum(weight) OVER w, 0) AS weights_before
  FROM weighed WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (total - caps_before) / (all_weight - weights_before) AS here FROM running),
levelled AS (SELECT *, max(CASE WHEN ratio > here THEN here END) OVER () AS level FROM levels),
targets AS (SELECT source, source_size, CASE WHEN level IS NULL OR ratio <= level THEN cap ELSE level * weight END AS target FROM levelled),
drawn AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':mix-1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u,
    ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':mix-1:window'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS v
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taking AS (
  SELECT *, least(floor(CASE WHEN source_size > 0 THEN size * target / source_size ELSE 0 END + u), size * 2)::BIGINT AS taken FROM drawn)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN size > 0 THEN taken // size ELSE 0 END::BIGINT AS whole,
  taken - CASE WHEN size > 0 THEN taken // size ELSE 0 END * size AS part,
  floor(v * (size - (taken - CASE WHEN size > 0 THEN taken // size ELSE 0 END * size) + 1))::BIGINT AS part_start
FROM taking
"""
