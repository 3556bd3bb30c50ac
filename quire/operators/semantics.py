"""Word vectors across periods, semantic networks and axes.

Vectors: word and v; across periods also period. Neighbours: word, neighbour, similarity, place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph as G
from . import similarity as V


def limited(vectors: DataFrame, counts: DataFrame, least: int = 0, most_ranked: int | None = None) -> DataFrame:
    """Vectors of words (word, n) that are frequent enough, or among the most frequent."""
    ok = counts.where(F.col("n") >= least)
    if most_ranked:
        ok = ok.orderBy(F.col("n").desc(), "word").limit(most_ranked)
    return vectors.join(ok.select("word"), "word", "left_semi")


def neighbours(vectors: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
    """The k nearest of each word of a bounded set (`within`, else all words given, which then are few)."""
    asked = vectors if within is None else vectors.join(within, "word", "left_semi")
    return V.nearest(asked, vectors, k, "word", "v").withColumnRenamed("query", "word")


def displacement(a: DataFrame, b: DataFrame) -> DataFrame:
    """word and the cosine distance of its vectors in two aligned models."""
    return a.select("word", F.col("v").alias("x")).join(b.select("word", F.col("v").alias("y")), "word").select("word", (1 - V.cosine(F.col("x"), F.col("y"))).alias("distance"))


def neighbourhood_change(a: DataFrame, b: DataFrame) -> DataFrame:
    """word and the Jaccard similarity of its neighbours (word, neighbour) in two models."""
    x, y = (n.groupBy("word").agg(F.collect_set("neighbour").alias(c)) for n, c in ((a, "x"), (b, "y")))
    return x.join(y, "word").select("word", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("jaccard"))


def ranks_over_periods(ranks: DataFrame, missing_rank: int = 666) -> DataFrame:
    """ranks: period, word, neighbour, place, similarity. Every pair in every period; missing: that rank, similarity 0."""
    periods = ranks.select("period").distinct()
    pairs = ranks.select("word", "neighbour").distinct()
    every = pairs.join(F.broadcast(periods))
    j = every.join(ranks, ["period", "word", "neighbour"], "left")
    return j.select("period", "word", "neighbour", F.coalesce("place", F.lit(missing_rank)).alias("place"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def rank_trends(over: DataFrame) -> DataFrame:
    """word, neighbour: slope and Pearson's r of the place over periods."""
    return over.groupBy("word", "neighbour").agg(F.regr_slope(F.col("place"), F.col("period")).alias("slope"), F.corr(F.col("place").cast("double"), F.col("period").cast("double")).alias("r"))


def network(near: DataFrame, least: float, core: int = 0) -> DataFrame:
    """Edges between similar words, of the k-core if asked."""
    edges = near.where(F.col("similarity") >= least).select(F.least("word", "neighbour").alias("src"), F.greatest("word", "neighbour").alias("dst"), "similarity").dropDuplicates(["src", "dst"])
    if core:
        ok = G.k_core(edges, core)
        edges = edges.join(ok.toDF("src"), "src", "left_semi").join(ok.toDF("dst"), "dst", "left_semi")
    return edges


def giant(edges: DataFrame) -> DataFrame:
    """The edges of the largest component (the smallest name of equal ones)."""
    comps = G.components(edges)
    largest = comps.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "component").limit(1).select("component")
    nodes = comps.join(F.broadcast(largest), "component", "left_semi").select(F.col("node").alias("src"))
    return edges.join(nodes, "src", "left_semi")


def partitions(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, part: label propagation; of equally frequent labels around a node the smallest wins."""
    both = G.kept(G.undirected(edges))
    now = both.select(F.col("src").alias("node")).distinct().withColumn("part", F.col("node"))
    for _ in range(rounds):
        votes = both.join(now.select(F.col("node").alias("dst"), "part"), "dst").groupBy("src", "part").agg(F.count("*").alias("n"))
        new = G.kept(votes.groupBy("src").agg(F.max_by("part", F.struct(F.col("n"), -F.xxhash64("part"))).alias("part")).toDF("node", "part"))
        moved = new.join(now.withColumnRenamed("part", "_old"), "node").where("part <> _old").limit(1).count()
        now = new
        if not moved:
            break
    return now


def blocks(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges between and inside parts, counted."""
    a, b = parts.select(F.col("node").alias("src"), F.col("part").alias("a")), parts.select(F.col("node").alias("dst"), F.col("part").alias("b"))
    return edges.join(a, "src").join(b, "dst").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))


def axis(vectors: DataFrame, plus: list[str], minus: list[str]) -> DataFrame:
    """One vector: the centroid of some words less that of others."""
    rows = vectors.withColumn("_g", F.when(F.col("word").isin(*plus), 1).when(F.col("word").isin(*minus), -1)).where("_g is not null")
    means = V.centroids(rows, "_g", "v").groupBy("dim").agg(F.sum(F.col("value") * F.col("_g")).alias("value"))
    return V.gathered(means.withColumn("axis", F.lit("axis")), "axis")


def on_axis(vectors: DataFrame, axes: DataFrame) -> DataFrame:
    """word, axis, score of every word on a few axes."""
    a = F.broadcast(axes.select("axis", F.col("v").alias("_a")))
    return vectors.join(a).select("word", "axis", V.cosine(F.col("v"), F.col("_a")).alias("score"))


def axis_statistics(scores: DataFrame, beyond: float = 0.1) -> DataFrame:
    share: Column = F.avg(F.when(F.abs(F.col("score")) > beyond, 1.0).otherwise(0.0))
    return scores.groupBy("axis").agg(F.var_pop("score").alias("variance"), F.skewness("score").alias("skewness"), F.kurtosis("score").alias("kurtosis"), share.alias("beyond"))


def cluster_correlation(series: DataFrame, clusters: DataFrame) -> DataFrame:
    """series: word, x, value; clusters: word, cluster. Pearson's r of each word with its cluster's median series."""
    j = series.join(clusters, "word")
    middle = j.groupBy("cluster", "x").agg(F.median("value").alias("_m"))
    return j.join(middle, ["cluster", "x"]).groupBy("word", "cluster").agg(F.corr("value", "_m").alias("r"))


def hubness(near: DataFrame) -> DataFrame:
    """How often each word is another's neighbour."""
    return near.groupBy(F.col("neighbour").alias("word")).agg(F.count("*").alias("n"))


def historical_groups(df: DataFrame, year: str, n: int, low: int, high: int, least: int) -> DataFrame:
    """Rows of years in [low, high) with their bin, if it has enough rows."""
    rows = df.where((F.col(year) >= low) & (F.col(year) < high)).withColumn("bin", (F.floor(F.col(year) / n) * n).cast("int"))
    large = rows.groupBy("bin").agg(F.count("*").alias("_c")).where(F.col("_c") >= least).select("bin")
    return rows.join(F.broadcast(large), "bin", "left_semi").select(*rows.columns)  # at most a row a year
