"""Graphs as edge tables: components, degrees, cores, closures, overlaps, running networks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.scratch import kept


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).toDF("src", "dst").where("src <> dst").distinct()


def _mark(edges: DataFrame) -> tuple:
    """How many edges there are and the sum of their hashes: equal for equal tables."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component: its component's smallest node, for nodes with an edge (src, dst). Large-star and small-star rounds
    (Kiveris and others, 2014) until nothing changes."""
    now = kept(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    mark = _mark(now)
    while True:
        around = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = kept(around.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = kept(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        last, mark = mark, _mark(new)
        now = new
        if mark == last:
            ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return ends.union(now.select(F.col("v"), F.col("v")).distinct()).toDF("node", "component").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def filtered(edges: DataFrame, min_weight: float | None = None, min_degree: int | None = None) -> DataFrame:
    """Edges over a weight whose ends then have enough edges (one pass)."""
    out = edges if min_weight is None else edges.where(F.col("weight") > min_weight)
    if min_degree:
        ok = degrees(out).where(F.col("degree") >= min_degree).select("node")
        out = out.join(ok.withColumnRenamed("node", "src"), "src", "left_semi").join(ok.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return out


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """The nodes left when those with fewer than k neighbours go, again and again."""
    now = kept(undirected(edges))
    while True:
        ok = now.groupBy(F.col("src").alias("n")).agg(F.count("*").alias("c")).where(F.col("c") >= k).select("n")
        new = kept(now.join(ok.withColumnRenamed("n", "src"), "src", "left_semi").join(ok.withColumnRenamed("n", "dst"), "dst", "left_semi"))
        if new.count() == now.count():
            return new.select(F.col("src").alias("node")).distinct()
        now = new


def two_hops(edges: DataFrame, least: int) -> DataFrame:
    """Pairs a < b of nodes that share at least so many neighbours, and how many."""
    both = undirected(edges)
    x, y = both.select(F.col("dst").alias("via"), F.col("src").alias("a")), both.select(F.col("dst").alias("via"), F.col("src").alias("b"))
    return x.join(y, "via").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """src, dst, hops: what is reached along directed edges in at most so many steps, and in how few."""
    step = kept(edges.select("src", "dst").distinct())
    all_, last = step.withColumn("hops", F.lit(1)), step
    for n in range(2, depth + 1):
        hop = last.select("src", F.col("dst").alias("via")).join(step.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        last = kept(hop.join(all_.select("src", "dst"), ["src", "dst"], "left_anti"))
        if not last.limit(1).count():
            break
        all_ = kept(all_.union(last.withColumn("hops", F.lit(n))))
    return all_


def running(events: DataFrame) -> DataFrame:
    """events: src, dst, t (ordered within an edge). The weight of each edge at each of its times, and the time since."""
    per = events.groupBy("src", "dst", "t").agg(F.count("*").alias("n"))
    w = Window.partitionBy("src", "dst").orderBy("t")
    return per.withColumn("weight", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("since", F.col("t") - F.lag("t").over(w)).drop("n")


def at_time(events: DataFrame, t) -> DataFrame:
    return events.where(F.col("t") <= t).groupBy("src", "dst").agg(F.count("*").alias("weight"), F.max("t").alias("last"))


def co_mentions(mentions: DataFrame, window: int, least: int) -> DataFrame:
    """mentions: doc, pos, name. Pairs of different names within so many positions, counted. Positions are dealt into
    cells as wide as the window, and a mention joins its own cell's and the next one's: no pair of cells beyond."""
    own = mentions.withColumn("cell", F.floor(F.col("pos") / window))
    a = own.select("doc", "cell", F.col("pos").alias("pa"), F.col("name").alias("a"))
    b = own.select("doc", F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("cell"), F.col("pos").alias("pb"), F.col("name").alias("b"))
    near = a.join(b, ["doc", "cell"]).where((F.col("pb") > F.col("pa")) & (F.col("pb") - F.col("pa") <= window) & (F.col("a") != F.col("b")))
    pair = near.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return pair.groupBy("src", "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def dynamic_edges(lines: DataFrame, column: str) -> DataFrame:
    """'a,b>c' as edges a>c and b>c; '<' the other way, '<>' both."""
    sides = lines.withColumn("_m", F.regexp_extract(column, "(<>|<|>)", 1)).where("_m <> ''").withColumn("_s", F.split(column, "<>|<|>"))
    ends = sides.select("*", F.explode(F.split(F.col("_s")[0], ",")).alias("l")).select("*", F.explode(F.split(F.col("_s")[1], ",")).alias("r"))
    ends = ends.select("*", F.trim("l").alias("_l"), F.trim("r").alias("_r"))
    forth = ends.where("_m in ('>', '<>')").select(F.col("_l").alias("src"), F.col("_r").alias("dst"))
    return forth.union(ends.where("_m in ('<', '<>')").select(F.col("_r"), F.col("_l")))


def static_edges(lines: DataFrame, column: str) -> DataFrame:
    """'name --> (type)target[meta]; (type)target[meta]' as src, rel, dst, meta."""
    rows = lines.withColumn("_s", F.trim(F.substring_index(column, "-->", 1))).withColumn("_r", F.explode(F.split(F.substring_index(column, "-->", -1), ";")))
    part = lambda pattern: F.trim(F.regexp_extract("_r", pattern, 1))
    return rows.select(F.col("_s").alias("src"), part(r"\(([^)]*)\)").alias("rel"), part(r"^\s*(?:\([^)]*\))?([^\[(]*)").alias("dst"), part(r"\[([^\]]*)\]").alias("meta")).where("dst <> ''")


def rescaled(edges: DataFrame, top: float, least: float = 1.0) -> DataFrame:
    """Weights scaled so that the largest is `top`, none below `least`."""
    most = edges.agg(F.max("weight").alias("_most"))
    return edges.join(F.broadcast(most)).withColumn("weight", F.greatest(F.lit(least), F.col("weight") * top / F.col("_most"))).drop("_most")


def web_mercator(latitude, longitude):
    """Longitude and latitude in degrees as metres east and north."""
    k = 6378137.0
    return (F.radians(longitude) * k).alias("x"), (F.log(F.tan(F.radians(latitude) / 2 + 0.7853981633974483)) * k).alias("y")


def property_edges(texts: DataFrame, columns: list[str]) -> DataFrame:
    """An edge from each text to each of its properties, 'column:value'."""
    pairs = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in columns])
    return texts.select(F.col("_id").alias("src"), F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("dst"))


def reachable(edges: DataFrame, start: list, depth: int) -> DataFrame:
    """node, hops: what is reached from some nodes, either way along edges, in at most so many steps."""
    both = kept(undirected(edges))
    spark = edges.sparkSession
    seen = spark.createDataFrame([(s, 0) for s in start], ["node", "hops"])
    last = seen.select("node")
    for n in range(1, depth + 1):
        last = kept(both.join(last.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti"))
        if not last.limit(1).count():
            break
        seen = kept(seen.union(last.withColumn("hops", F.lit(n).cast(seen.schema["hops"].dataType))))
    return seen


def touching(edges: DataFrame, node) -> DataFrame:
    return edges.where((F.col("src") == node) | (F.col("dst") == node))


def nodes_where(nodes: DataFrame, **equal) -> DataFrame:
    """Nodes whose columns have given values."""
    return nodes.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in equal.items()], F.lit(True)))


def nodes_starting(nodes: DataFrame, **prefixes) -> DataFrame:
    """Nodes whose columns begin with given strings, whatever their case."""
    return nodes.where(reduce(lambda a, b: a & b, [F.lower(k).startswith(v.lower()) for k, v in prefixes.items()], F.lit(True)))


def clustering(edges: DataFrame) -> DataFrame:
    """node, degree, triangles, coefficient: the share of a node's pairs of neighbours that are neighbours themselves.

    Each edge is listed at its end of the smaller degree, so a hub's neighbours are never paired with each other: there are
    at most as many open pairs as edges to the power of 1.5."""
    both = kept(undirected(edges))
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    of = lambda end, name: degree.select(F.col("node").alias(end), F.col("degree").alias(name))
    known = both.join(of("src", "_s"), "src").join(of("dst", "_d"), "dst")
    up = kept(known.where(F.struct("_s", "src") < F.struct("_d", "dst")).select("src", "dst"))
    pairs = up.select("src", F.col("dst").alias("x")).join(up.select("src", F.col("dst").alias("y")), "src").where("x < y")
    closed = pairs.join(both.select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"])
    triangles = closed.select(F.explode(F.array("src", "x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    out = degree.join(triangles, "node", "left").na.fill(0, ["triangles"])
    return out.withColumn("coefficient", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(F.lit(0.0)))
