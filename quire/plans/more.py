"""Bibliographic, semantic and further network queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import bibliography as B
from quire.functions import text as T
from quire.operators import graph as G
from quire.operators import semantics as M
from quire.operators import similarity as V
from quire.sources import tables as S

from .base import TEXTS, TOKENS, query


@query("SELECT o_orderkey, (1000 + o_orderkey % 1500)::INTEGER AS imprint, CASE WHEN 1000 + o_orderkey % 1500 <= 2100 THEN 1000 + o_orderkey % 1500 END::INTEGER AS marc FROM orders")
def imprint_years(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey", (F.lit(1000) + F.col("o_orderkey") % 1500).cast("string").alias("y"))
    return o.select("o_orderkey", B.imprint_year(F.concat(F.lit("London: "), "y", F.lit("."))).alias("imprint"), B.marc_year("y").alias("marc"))


RULES = [("form", "promo", "Fiction"), ("form", "economy", "Poetry"), ("title", "ring", "Drama"), ("title", "bolt", "Sermon"), ("title", "red", "Letters")]


@query("""WITH a AS (SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Fiction' WHEN 'ECONOMY' THEN 'Poetry' END AS f,
  concat_ws('|', CASE WHEN p_name LIKE '% ring' THEN 'Drama' END, CASE WHEN p_name LIKE 'red %' THEN 'Letters' END, CASE WHEN p_name LIKE '% bolt' THEN 'Sermon' END) AS t FROM part)
SELECT p_partkey, coalesce(f, t) AS genres, CASE WHEN f IS NOT NULL THEN 'form' WHEN t <> '' THEN 'title' END AS genre_source FROM a""")
def classify_genres(spark, d):
    p = S.table(spark, d, "part").select("p_partkey", F.col("p_type").alias("form"), F.col("p_name").alias("title"))
    return B.classified(p, RULES).select("p_partkey", F.array_join("genres", "|").alias("genres"), "genre_source")


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'Fiction' WHEN p_name LIKE '% ring' AND p_type <> 'ECONOMY' THEN 'Drama' END AS broad FROM part")
def harmonise_genres(spark, d):
    p = S.table(spark, d, "part").select("p_partkey", F.col("p_type").alias("form"), F.col("p_name").alias("title"))
    return B.classified(p, RULES).select("p_partkey", B.harmonised(F.col("genres"), {"Fiction": "Fiction", "Drama": "Drama"}, ["Fiction", "Drama"]).alias("broad"))


@query("SELECT page_id, CASE WHEN len(regexp_extract_all(html, '</speaker>')) > 100 THEN 'Drama' WHEN len(regexp_extract_all(html, '<l\\b')) > len(regexp_extract_all(html, '<p\\b')) THEN 'Verse' ELSE 'Prose' END AS genre FROM pages")
def markup_genre(spark, d):
    return S.table(spark, d, "pages").select("page_id", B.markup_genre("html").alias("genre"))


@query("""WITH w AS (SELECT p_partkey, p_brand, p_size, list_distinct(string_split(p_name, ' ')) AS w FROM part),
p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, list_sort(list_intersect(a.w, b.w)) AS c, list_sort(list_filter(a.w, lambda x: NOT list_contains(b.w, x))) AS x, list_sort(list_filter(b.w, lambda x: NOT list_contains(a.w, x))) AS y
  FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey),
t AS (SELECT a, b, array_to_string(c, ' ') AS c, array_to_string(list_concat(c, x), ' ') AS l, array_to_string(list_concat(c, y), ' ') AS r FROM p),
s AS (SELECT a, b, c, unnest([struct_pack(u := l, v := r, k := true), struct_pack(u := c, v := l, k := c <> ''), struct_pack(u := c, v := r, k := c <> '')]) AS z FROM t)
SELECT a, b, round(max(CASE WHEN z.k THEN 100 * (1 - levenshtein(z.u, z.v) / greatest(length(z.u), length(z.v), 1)) END)::DOUBLE, 6) AS ratio FROM s GROUP BY a, b""")
def token_set_pairs(spark, d):
    p = S.table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.split("p_name", " ").alias("w"))
    a, b = p.alias("a"), p.alias("b")
    on = (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_size") == F.col("b.p_size")) & (F.col("a.p_partkey") < F.col("b.p_partkey"))
    return a.join(b, on).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), F.round(B.token_set_ratio(F.col("a.w"), F.col("b.w")), 6).alias("ratio"))


def labels(spark, d, odd: bool):
    e = S.table(spark, d, "embeddings").where(F.col("vec_id") % 2 == int(odd))
    return V.gathered(V.centroids(e.withColumn("word", F.concat(F.lit("l"), F.col("label").cast("string"))), "word", "embedding"), "word")


HALVES = """x AS (SELECT 'l' || label AS word, vec_id % 2 AS h, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT word, h, dim, avg(x) AS value FROM x GROUP BY ALL), v AS (SELECT word, h, list(value ORDER BY dim) AS v FROM c GROUP BY ALL)"""


@query(f"WITH {HALVES} SELECT a.word, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance FROM v a JOIN v b ON a.word = b.word AND a.h = 0 AND b.h = 1")
def semantic_displacement(spark, d):
    return M.displacement(labels(spark, d, False), labels(spark, d, True)).withColumn("distance", F.round("distance", 6))


NEAR = f"""{HALVES}, p AS (SELECT a.h, a.word, b.word AS neighbour, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.h = b.h AND a.word <> b.word),
r AS (SELECT *, row_number() OVER (PARTITION BY h, word ORDER BY s DESC, neighbour)::INTEGER AS place FROM p), near AS (SELECT * FROM r WHERE place <= 4)"""


@query(f"""WITH {NEAR}, i AS (SELECT x.word, count(*) AS c FROM near x JOIN near y ON x.word = y.word AND x.neighbour = y.neighbour AND x.h = 0 AND y.h = 1 GROUP BY x.word)
SELECT w.word, round(coalesce(c, 0) / (8 - coalesce(c, 0)), 6) AS jaccard FROM (SELECT DISTINCT word FROM near) w LEFT JOIN i ON i.word = w.word""")
def neighbourhood_change(spark, d):
    a, b = (M.neighbours(labels(spark, d, o), 4) for o in (False, True))
    return M.neighbourhood_change(a, b).withColumn("jaccard", F.round("jaccard", 6))


def ranked(spark, d):
    from functools import reduce

    return reduce(lambda x, y: x.unionByName(y), [M.neighbours(labels(spark, d, bool(o)), 4).withColumn("period", F.lit(o)) for o in (0, 1)])


@query(f"""WITH {NEAR}, pairs AS (SELECT DISTINCT word, neighbour FROM near), e AS (SELECT * FROM pairs CROSS JOIN (SELECT unnest([0, 1]) AS period))
SELECT e.period::INTEGER AS period, e.word, e.neighbour, coalesce(n.place, 666)::INTEGER AS place, round(coalesce(n.s, 0), 6) AS similarity FROM e LEFT JOIN near n ON n.h = e.period AND n.word = e.word AND n.neighbour = e.neighbour""")
def ranks_over_periods(spark, d):
    return M.ranks_over_periods(ranked(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {NEAR}, pairs AS (SELECT DISTINCT word, neighbour FROM near)
SELECT p.word, p.neighbour, (coalesce(b.place, 666) - coalesce(a.place, 666))::DOUBLE AS slope FROM pairs p LEFT JOIN near a ON a.h = 0 AND a.word = p.word AND a.neighbour = p.neighbour LEFT JOIN near b ON b.h = 1 AND b.word = p.word AND b.neighbour = p.neighbour""")
def rank_trends(spark, d):
    return M.rank_trends(M.ranks_over_periods(ranked(spark, d))).select("word", "neighbour", F.round("slope", 6).alias("slope"))


def all_labels(spark, d):
    e = S.table(spark, d, "embeddings").withColumn("word", F.concat(F.lit("l"), F.col("label").cast("string")))
    return V.gathered(V.centroids(e, "word", "embedding"), "word")


WHOLE = """x AS (SELECT 'l' || label AS word, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT word, dim, avg(x) AS value FROM x GROUP BY ALL), v AS (SELECT word, list(value ORDER BY dim) AS v FROM c GROUP BY ALL)"""
AXIS = """m AS (SELECT dim, avg(value) FILTER (word IN ('l0', 'l1')) - avg(value) FILTER (word IN ('l2', 'l3')) AS value FROM c GROUP BY dim), a AS (SELECT list(value ORDER BY dim) AS a FROM m),
s AS (SELECT word, list_cosine_similarity(v, a) AS score FROM v, a)"""


@query(f"""WITH {WHOLE}, p AS (SELECT a.word, b.word AS neighbour, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.word <> b.word),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY s DESC, neighbour) AS place FROM p) SELECT neighbour AS word, count(*)::BIGINT AS n FROM r WHERE place <= 4 GROUP BY 1""")
def hubness(spark, d):
    return M.hubness(M.neighbours(all_labels(spark, d), 4))


@query(f"WITH {WHOLE}, {AXIS} SELECT word, round(score, 6) AS score FROM s")
def semantic_axis(spark, d):
    v = all_labels(spark, d)
    return M.on_axis(v, M.axis(v, ["l0", "l1"], ["l2", "l3"])).select("word", F.round("score", 6).alias("score"))


@query(f"""WITH {WHOLE}, {AXIS}, k AS (SELECT avg(score) AS m FROM s), q AS (SELECT avg((score - m) ** 2) AS v, avg((score - m) ** 3) AS t, avg((score - m) ** 4) AS f, avg(CASE WHEN abs(score) > 0.1 THEN 1.0 ELSE 0.0 END) AS beyond FROM s, k)
SELECT 'axis' AS axis, round(v, 6) AS variance, round(t / v ** 1.5, 6) AS skewness, round(f / v ** 2 - 3, 6) AS kurtosis, round(beyond, 6) AS beyond FROM q""")
def axis_statistics(spark, d):
    v = all_labels(spark, d)
    out = M.axis_statistics(M.on_axis(v, M.axis(v, ["l0", "l1"], ["l2", "l3"])))
    return out.select("axis", *[F.round(c, 6).alias(c) for c in ("variance", "skewness", "kurtosis", "beyond")])


def brand_edges(spark, d):
    return S.table(spark, d, "part").select(F.col("p_brand").alias("src"), F.col("p_name").alias("dst")).distinct()


@query()
def partitions(spark, d):
    return M.partitions(brand_edges(spark, d))


@query("SELECT 'brand:' || p_brand AS dst, count(*)::BIGINT AS n FROM part GROUP BY 1 UNION ALL SELECT 'type:' || p_type, count(*) FROM part GROUP BY 1")
def property_graph(spark, d):
    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return G.property_edges(p, ["brand", "type"]).groupBy("dst").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT conv_id AS a, conv_id + 1 + conv_id % 3 AS b FROM conversations), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT 10::BIGINT AS node, 0::BIGINT AS hops UNION SELECT u.b, r.hops + 1 FROM r JOIN u ON u.a = r.node WHERE r.hops < 4) SELECT node, min(hops) AS hops FROM r GROUP BY node""")
def reachable(spark, d):
    c = S.table(spark, d, "conversations").select(F.col("conv_id").alias("src"), (F.col("conv_id") + 1 + F.col("conv_id") % 3).alias("dst"))
    return G.reachable(c, [10], 4)


@query("SELECT c_custkey, round(radians(c_acctbal / 100) * 6378137.0, 2) AS x, round(ln(tan(radians(c_acctbal / 200) / 2 + pi() / 4)) * 6378137.0, 2) AS y FROM customer")
def web_mercator(spark, d):
    c = S.table(spark, d, "customer")
    x, y = G.web_mercator(F.col("c_acctbal") / 200, F.col("c_acctbal") / 100)
    return c.select("c_custkey", x, y).select("c_custkey", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query(f"WITH {TEXTS}, r AS (SELECT _id, (year // 50 * 50)::INTEGER AS bin FROM texts WHERE year >= 1650 AND year < 1800), c AS (SELECT bin FROM r GROUP BY bin HAVING count(*) >= 5) SELECT _id, bin FROM r WHERE bin IN (SELECT bin FROM c)")
def historical_groups(spark, d):
    return M.historical_groups(S.texts(spark, d).select("_id", "year"), "year", 50, 1650, 1800, 5).select("_id", "bin")


@query(f"""WITH {TEXTS}, a AS (SELECT _id, {TOKENS} AS t FROM texts) SELECT _id, list_aggregate(t[1:20], 'string_agg', ' ') AS first, list_aggregate(t[greatest(len(t) - 19, 1):len(t)], 'string_agg', ' ') AS last FROM a WHERE len(t) > 0""")
def word_windows(spark, d):
    def ends(t):
        return F.struct(F.array_join(F.slice(t, 1, 20), " ").alias("first"), F.array_join(F.slice(t, F.greatest(F.size(t) - 19, F.lit(1)), 20), " ").alias("last"), F.size(t).alias("n"))

    return S.texts(spark, d).select("_id", T.let(T.tokens("text"), ends).alias("e")).where("e.n > 0").select("_id", "e.first", "e.last")


@query("SELECT label::BIGINT AS label, round(corr(x, m), 6) AS r FROM (SELECT label, o, x, median(x) OVER (PARTITION BY label % 2, o) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS o, unnest(embedding)::DOUBLE AS x FROM embeddings)) GROUP BY label")
def cluster_correlation(spark, d):
    e = S.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("word"), F.posexplode("embedding").alias("x", "value")).withColumn("value", F.col("value").cast("double"))
    parts = e.select("word", (F.col("word") % 2).alias("cluster")).distinct()
    return M.cluster_correlation(e, parts).select(F.col("word").alias("label"), F.round("r", 6).alias("r"))
