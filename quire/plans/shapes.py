"""Queries over places, running sums, reshaped tables, networks of distances and further scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import bibliography as B
from quire.functions import text as T
from quire.operators import explore as X
from quire.operators import graph as G
from quire.operators import matching as M
from quire.operators import ordering as O
from quire.operators import shapes as H
from quire.operators import similarity as V
from quire.sources import tables as S

from .base import TEXTS, query
from .matching import GROUPS, RECORDS, exact_groups, records
from .more import HALVES, WHOLE, all_labels, labels
from .structure import CENTROIDS, label_distances


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS place FROM orders")
def places(spark, d):
    return O.placed(S.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"]).select("o_orderkey", "place")


@query("SELECT l_orderkey, l_linenumber, sum(l_linenumber) OVER (ORDER BY l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def running_sums(spark, d):
    rows = S.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")).distinct()
    return O.cumulated(rows, ["l_orderkey", "l_linenumber"], {"so_far": "l_linenumber"}).withColumn("l_linenumber", F.col("l_linenumber").cast(S.table(spark, d, "lineitem").schema["l_linenumber"].dataType))


@query("""WITH a AS (SELECT o_totalprice AS threshold, count(*) AS n, sum(o_orderkey % 2) AS t FROM orders GROUP BY 1)
SELECT threshold, sum(t) OVER w::DOUBLE / sum(n) OVER w::DOUBLE AS precision, sum(t) OVER w::DOUBLE / sum(t) OVER ()::DOUBLE AS recall FROM a WINDOW w AS (ORDER BY threshold DESC)""")
def pr_curve(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_totalprice").alias("p"), (F.col("o_orderkey") % 2).alias("label"))
    return V.pr_curve(o)


@query("SELECT p_partkey, p_name, b AS b_b, c_n AS c_n FROM (SELECT p_partkey, p_name, p_brand AS b, p_size AS c_n FROM part)")
def flattened_structs(spark, d):
    inner = F.struct(F.col("p_brand").alias("b"), F.struct(F.col("p_size").alias("n")).alias("c")).alias("b")
    return H.flattened(S.table(spark, d, "part").select("p_partkey", "p_name", inner))


@query("SELECT p_partkey, p_name, p_brand AS \"group\" FROM part")
def grouped_rows(spark, d):
    p = S.table(spark, d, "part")
    lists = p.groupBy("p_brand").agg(F.collect_list(F.struct("p_partkey", "p_name")).alias("rows"))
    return H.grouped_rows(lists, "rows", "p_brand")


def _metadata(spark, d):
    p = S.table(spark, d, "part")
    meta = F.create_map(F.lit("title"), F.col("p_name"), F.lit("title__" + "estc"), F.upper("p_name"), F.lit("brand__" + "ecco"), F.col("p_brand"))
    return p.select(F.col("p_partkey").alias("id"), meta.alias("meta"), F.col("p_type").alias("corpus"))


@query("SELECT p_partkey AS source, unnest(['title', 'title__estc']) AS key, unnest([p_name, upper(p_name)]) AS value FROM part")
def metadata_triples(spark, d):
    return H.triples(_metadata(spark, d), "id", "meta", "title")


@query("SELECT p_partkey AS _id, unnest([p_type, 'estc', 'ecco']) AS corpus, unnest(['title', 'title', 'brand']) AS key, unnest([p_name, upper(p_name), p_brand]) AS value FROM part")
def metadata_by_source(spark, d):
    return H.by_source(_metadata(spark, d), "id", "meta", F.col("corpus"))


@query("SELECT p_partkey AS _id, unnest([p_type, 'estc', 'ecco']) AS corpus, 1::BIGINT AS n FROM part")
def source_counts(spark, d):
    return H.source_counts(H.by_source(_metadata(spark, d), "id", "meta", F.col("corpus")))


@query("SELECT _id, title, year, brand, kind FROM (SELECT '_' || p_type || '/' || p_partkey AS _id, p_name AS title, (1900 + p_size)::INTEGER AS year, p_brand AS brand, CASE WHEN p_size % 2 = 0 THEN p_type END AS kind FROM part) ORDER BY year, title, _id LIMIT 100000")
def metadata_download(spark, d):
    p = S.table(spark, d, "part")
    own = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    meta = F.to_json(F.struct(F.col("p_brand").alias("brand"), own.alias("kind"), F.col("p_name").alias("title")))
    return H.download(S.parts(spark, d).select("_id", "title", "year").join(p.select(F.concat(F.lit("_"), "p_type", F.lit("/"), F.col("p_partkey").cast("string")).alias("_id"), meta.alias("meta")), "_id"))


@query("""WITH t AS (SELECT 'User ' || user_id AS char_tok FROM events UNION ALL SELECT event_type FROM events), c AS (SELECT char_tok, count(*)::BIGINT AS char_tok_count FROM t WHERE char_tok <> '' GROUP BY 1)
SELECT char_tok, char_tok_count, lower(regexp_replace(char_tok, '[^A-Za-z0-9]', '', 'g')) AS char_id, row_number() OVER (ORDER BY char_tok_count DESC, char_tok)::BIGINT AS char_tok_i FROM c""")
def character_tokens(spark, d):
    e = S.table(spark, d, "events").select(F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("sender_tok"), F.col("event_type").alias("recip_tok"))
    return H.character_tokens(e, ["sender_tok", "recip_tok"], lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "")))


@query(f"WITH {TEXTS} SELECT _id, year FROM texts WHERE (corpus = (SELECT min(corpus) FROM texts) AND year >= 1700) OR (corpus = (SELECT max(corpus) FROM texts) AND id = '1')")
def chosen_texts(spark, d):
    t = S.texts(spark, d)
    low, high = t.agg(F.min("corpus"), F.max("corpus")).first()
    corpora = {"first": t.where(F.col("corpus") == low), "last": t.where(F.col("corpus") == high)}
    return X.chosen(corpora, "first|year >= 1700; last|1").select("_id", "year")


@query(f"""WITH RECURSIVE {RECORDS}, {GROUPS}, s AS (SELECT "group", count(*)::BIGINT AS total_members FROM groups GROUP BY 1 ORDER BY 1 LIMIT 5 OFFSET 5)
SELECT "group", _id, rank, total_members FROM groups JOIN s USING ("group") WHERE rank < 3""")
def match_page(spark, d):
    return M.grouped_page(exact_groups(spark, d), 2, 5, 3).select("group", "_id", "rank", "total_members")


EDGES = "SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT 'b' || p_brand AS x, 't' || p_type AS y FROM part UNION ALL SELECT 't' || p_type, 'n' || p_name FROM part UNION ALL SELECT 'b' || p_brand, 'n' || p_name FROM part)"


def _edges(spark, d):
    p = S.table(spark, d, "part").select(F.concat(F.lit("b"), "p_brand").alias("b"), F.concat(F.lit("t"), "p_type").alias("t"), F.concat(F.lit("n"), "p_name").alias("n"))
    return p.select("b", "t").union(p.select("t", "n")).union(p.select("b", "n")).toDF("src", "dst").distinct()


@query(f"""WITH e AS ({EDGES}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), g AS (SELECT a AS node, count(*)::BIGINT AS degree FROM u GROUP BY a),
t AS (SELECT x.a AS node, count(*)::BIGINT AS n FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY x.a)
SELECT node, degree, coalesce(n, 0)::BIGINT AS triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(n, 0) / (degree * (degree - 1)) ELSE 0 END::DOUBLE, 6) AS coefficient FROM g LEFT JOIN t USING (node)""")
def clustering_coefficients(spark, d):
    return G.clustering(_edges(spark, d)).withColumn("coefficient", F.round("coefficient", 6))


@query("SELECT DISTINCT p_brand AS src, p_type AS dst FROM part WHERE p_type = 'PROMO'")
def edges_of_node(spark, d):
    return G.touching(S.table(spark, d, "part").select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")).distinct(), "PROMO")


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO' AND p_size = 7 UNION ALL SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE 'red%'")
def nodes_found(spark, d):
    p = S.table(spark, d, "part")
    return G.nodes_where(p, p_type="PROMO", p_size=7).unionByName(G.nodes_starting(p, p_name="RED")).select("p_partkey", "p_name")


@query(f"WITH {WHOLE} SELECT dim::INTEGER - 1 AS dim, round(sum(CASE word WHEN 'l0' THEN value WHEN 'l1' THEN -value ELSE 2 * value END), 6) AS value FROM c WHERE word IN ('l0', 'l1', 'l2') GROUP BY dim")
def vector_expression(spark, d):
    v = V.combined(all_labels(spark, d), "l0 - l1 + l2 + l2")
    return v.select(F.posexplode("v").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(f"""WITH {HALVES}, p AS (SELECT a.h, a.word AS a, b.word AS b, 1 - list_cosine_similarity(a.v, b.v) AS distance FROM v a JOIN v b ON a.h = b.h AND a.word < b.word)
SELECT a, b, round(median(distance), 6) AS distance FROM p GROUP BY a, b""")
def median_distances(spark, d):
    of = lambda odd: V.distances(labels(spark, d, odd).withColumnRenamed("word", "id"))
    return V.median_distances(of(False).unionByName(of(True))).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {CENTROIDS}, c2 AS (SELECT distance FROM dist WHERE distance <> 0 ORDER BY distance, a, b LIMIT 1 OFFSET 10)
SELECT a AS src, b AS dst, round(1 - distance, 6) AS weight FROM dist WHERE distance < (SELECT distance FROM c2)""")
def nearest_network(spark, d):
    return V.nearest_network(label_distances(spark, d), 5).withColumn("weight", F.round("weight", 6))


@query("""SELECT c_custkey, CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 1) || '#' ELSE c_name END AS first, c_name AS joined,
c_mktsegment || '|' || c_name AS piped, c_mktsegment AS cut FROM customer""")
def string_shapes(spark, d):
    pieces = T.split_keeping("c_name", "#")
    piped = T.pipe_joined(F.array(F.concat(F.lit(" "), "c_mktsegment"), F.lit(" "), F.lit(None).cast("string"), F.concat("c_name", F.lit("\n"))))
    return S.table(spark, d, "customer").select("c_custkey", pieces[0].alias("first"), F.array_join(pieces, "").alias("joined"), piped.alias("piped"), T.marks_cut(F.concat("c_mktsegment", F.lit(" /:.,;"))).alias("cut"))


@query(f"WITH {TEXTS} SELECT _id, CASE genre WHEN 'Fiction' THEN 'Prose' WHEN 'Poetry' THEN 'Verse' ELSE '' END AS form FROM texts")
def prose_or_verse(spark, d):
    return S.texts(spark, d).select("_id", B.prose_or_verse(F.lit(None).cast("string"), F.col("genre")).alias("form"))


@query("SELECT p_partkey, p_size + 11 + 3 AS pages FROM part")
def page_sums(spark, d):
    raw = F.concat(F.lit("xi, [3], "), F.col("p_size").cast("string"), F.lit(" p., [2] leaves of plates"))
    return S.table(spark, d, "part").select("p_partkey", B.page_sum(raw).alias("pages"))
