"""Queries over sections, vectors, statistics and networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import graph as G
from quire.operators import jaccard as J
from quire.operators import sections as C
from quire.operators import similarity as V
from quire.operators import words as W
from quire.sources import tables as S
from quire.sources.scratch import few_rows_at_once, kept

from .base import TEXTS, TOKENS, WORDS, query

SPLIT = r"list_filter(regexp_split_to_array({}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"


@query(rf"""WITH {TEXTS}, a AS (SELECT _id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n[ \t]*\n'), lambda x: trim(x)), lambda x: x <> '') AS p FROM texts),
b AS (SELECT _id, unnest(p) AS paragraph, generate_subscripts(p, 1)::INTEGER AS place FROM a)
SELECT _id, printf('P%04d', place) AS section_id, place, len({SPLIT.format('paragraph')})::INTEGER AS n_words, md5(paragraph) AS paragraph FROM b""")
def paragraphs(spark, d):
    t = S.texts(spark, d).select("_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return C.paragraphs(t).withColumn("paragraph", F.md5(F.col("paragraph").cast("binary")))


@query()
def passages(spark, d):
    return C.passages(S.texts(spark, d), 100)


@query(f"""WITH {TEXTS}, a AS (SELECT _id, {TOKENS} AS t FROM texts), b AS (SELECT _id, t, unnest(range(0, len(t) // 50))::INTEGER AS place FROM a)
SELECT _id, place, array_to_string(t[place * 50 + 1 : place * 50 + 50], ' ') AS slice FROM b""")
def fixed_slices(spark, d):
    return C.slices(S.texts(spark, d), 50)


@query(f"""WITH {TEXTS}, a AS (SELECT {TOKENS} AS t FROM texts), b AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS ngram FROM a)
SELECT ngram, count(*)::BIGINT AS n FROM b GROUP BY ngram""")
def bigrams(spark, d):
    return C.ngram_counts(S.texts(spark, d), 2)


@query(f"""WITH {TEXTS}, a AS (SELECT _id, {TOKENS} AS t FROM texts), b AS (SELECT _id, t, unnest(range(0, len(t)))::INTEGER AS pos FROM a)
SELECT _id, pos, array_to_string(t[greatest(pos - 3, 1) : pos], ' ') AS "left", array_to_string(t[pos + 2 : pos + 5], ' ') AS "right" FROM b WHERE t[pos + 1] = 'was'""")
def kwic(spark, d):
    return C.keyword_in_context(S.texts(spark, d), "was", 8)


@query("""SELECT conv_id, turn, sum(length(text) + 5) OVER w::BIGINT - length(text) - 5 AS start, sum(length(text) + 5) OVER w::BIGINT - 5 AS "end" FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def section_offsets(spark, d):
    return C.offsets(S.table(spark, d, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("SELECT conv_id, md5(string_agg(text, repeat(chr(10), 5) ORDER BY turn)) AS text FROM conversations GROUP BY conv_id")
def section_concat(spark, d):
    return C.concatenated(S.table(spark, d, "conversations"), "conv_id", "turn").withColumn("text", F.md5(F.col("text").cast("binary")))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' '), '&hyphen;', '-') AS t FROM a)
SELECT page_id, trim(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ') AS text FROM b""")
def html_to_text(spark, d):
    return S.table(spark, d, "pages").select("page_id", T.unhtml("html").alias("text"))


TAGS = ["p", "li", "div", "td"]


@query("""WITH c AS (SELECT page_id, unnest([struct_pack(n := len(regexp_extract_all(html, '<p\\b')), k := 0, tag := 'p'), struct_pack(n := len(regexp_extract_all(html, '<li\\b')), k := 1, tag := 'li'),
struct_pack(n := len(regexp_extract_all(html, '<div\\b')), k := 2, tag := 'div'), struct_pack(n := len(regexp_extract_all(html, '<td\\b')), k := 3, tag := 'td')]) AS s FROM pages)
SELECT page_id, CASE WHEN max(s.n) > 0 THEN arg_max(s.tag, s.n * 10 + s.k) END AS tag FROM c GROUP BY page_id""")
def largest_section_tag(spark, d):
    return C.largest_tag(S.table(spark, d, "pages"), "html", TAGS).select("page_id", "tag")


@query("SELECT page_id, len(regexp_extract_all(html, '(?s)<p\\b[^>]*>(.*?)</p>'))::BIGINT AS n FROM pages WHERE len(regexp_extract_all(html, '(?s)<p\\b[^>]*>(.*?)</p>')) > 0")
def page_sections(spark, d):
    return C.tagged_sections(S.table(spark, d, "pages"), "page_id", "html", "p").groupBy("page_id").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, list_cosine_similarity(q.v, e.v) AS s FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour)::INTEGER AS place FROM p)
SELECT query, neighbour, round(s, 6) AS similarity, place FROM r WHERE place <= 5""")
def cosine_knn(spark, d):
    e = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return V.nearest(e.where("id % 50 = 0"), e, 5).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {WORDS}, m AS (SELECT word FROM word_index GROUP BY word ORDER BY sum("count") DESC, word LIMIT 5000), l AS (SELECT * FROM word_index WHERE word IN (SELECT word FROM m)), d AS (SELECT word, count(*) AS df FROM l GROUP BY word),
w AS (SELECT _id, word, "count" * (ln((1.0 + (SELECT count(*) FROM texts)) / (1 + df)) + 1) AS w FROM l JOIN d USING (word)),
u AS (SELECT _id, word, w / sqrt(sum(w * w) OVER (PARTITION BY _id)) AS weight FROM w),
p AS (SELECT a._id AS a, b._id AS b, round(sum(a.weight * b.weight), 6) AS similarity FROM u a JOIN u b ON a.word = b.word AND a._id <> b._id GROUP BY 1, 2 HAVING round(sum(a.weight * b.weight), 6) >= 0.8),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS n FROM p)
SELECT DISTINCT least(a, b) AS id_1, greatest(a, b) AS id_2, round(similarity, 4) AS similarity FROM r WHERE n <= 10""")
def find_duplicates(spark, d):
    texts = S.texts(spark, d).select("_id", "text")
    n = texts.count()
    if texts.where("_id is not null").groupBy("_id").count().where("count > 1").limit(1).count():  # rows of one text: counted together
        index = S.stored_index(spark, d)
        rows = index.join(F.broadcast(W.most_frequent(index, 5000).select("word")), "word", "left_semi").select("_id", "word", F.col("count").alias("n"))
        return V.duplicates(W.tfidf_smooth(rows, F.lit(n)).select("_id", "word", "weight"))
    with few_rows_at_once(spark):
        lists = kept(W.word_lists(texts), "word-lists")
        words = W.frequent_in(lists, 5000).collect()
        rows = kept(W.packed_counts(lists, [r.word for r in words]), "counts")
    return V.duplicate_rows(rows, len(words), np.log((1 + n) / (1 + np.array([r.df for r in words], float))) + 1)


CENTROIDS = """x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, dim, avg(x) AS value FROM x GROUP BY ALL),
v AS (SELECT label, list(value ORDER BY dim) AS v FROM c GROUP BY label),
dist AS (SELECT a.label AS a, b.label AS b, 1 - list_cosine_similarity(a.v, b.v) AS distance FROM v a JOIN v b ON a.label < b.label)"""


def centroids(spark, d):
    return V.centroids(S.table(spark, d, "embeddings"), "label", "embedding")


@query(f"WITH {CENTROIDS} SELECT label, dim::INTEGER AS dim, round(value, 6) AS value FROM c")
def centroid_by_label(spark, d):
    return centroids(spark, d).withColumn("value", F.round("value", 6))


def label_distances(spark, d):
    return V.distances(V.gathered(centroids(spark, d), "label").withColumnRenamed("label", "id"))


@query(f"WITH {CENTROIDS} SELECT a, b, round(distance, 6) AS distance FROM dist")
def distance_matrix(spark, d):
    return label_distances(spark, d).withColumn("distance", F.round("distance", 6))


@query(f"WITH {CENTROIDS} SELECT a, b, round(distance, 6) AS distance FROM dist ORDER BY distance, a, b LIMIT 10")
def top_connections(spark, d):
    return V.top_connections(label_distances(spark, d), 10).withColumn("distance", F.round("distance", 6))


@query("""WITH s AS (SELECT DISTINCT p_brand AS k, p_name AS x FROM part), n AS (SELECT k, count(*) AS n FROM s GROUP BY k)
SELECT a.k AS a, b.k AS b, round(count(*) / (any_value(na.n) + any_value(nb.n) - count(*)), 6) AS jaccard FROM s a JOIN s b ON a.x = b.x AND a.k < b.k JOIN n na ON na.k = a.k JOIN n nb ON nb.k = b.k GROUP BY 1, 2""")
def neighbour_jaccard(spark, d):
    lists = S.table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("names"))
    return V.set_jaccard(lists, "p_brand", "names").withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH {TEXTS}, s AS (SELECT _id, list_sort(list_distinct({TOKENS})) AS w FROM texts), r AS (SELECT w, min(_id) AS rep, len(w) AS n FROM s WHERE len(w) > 0 GROUP BY w),
p AS (SELECT x.rep AS a, y.rep AS b, x.n + y.n AS n, len(list_intersect(x.w, y.w)) AS c FROM r x JOIN r y ON x.rep < y.rep AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n))
SELECT a, b, round(c / (n - c), 6) AS similarity FROM p WHERE 100 * c >= 80 * (n - c) UNION ALL SELECT r.rep, s._id, 1.0 FROM s JOIN r USING (w) WHERE s._id <> r.rep""")
def minhash_pairs(spark, d):
    """The pairs that MinHash estimates, exactly: between the smallest _ids of different sets of words, and from these to their copies."""
    return J.alike(S.texts(spark, d), T.tokens("text"), 80).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {TEXTS}, g AS (SELECT genre, (year // 10 * 10)::INTEGER AS period, count(*)::DOUBLE AS n FROM texts GROUP BY ALL)
SELECT a.genre AS a, b.genre AS b, round(corr(a.n, b.n), 6) AS r, count(*)::BIGINT AS n FROM g a JOIN g b ON a.period = b.period AND a.genre < b.genre GROUP BY 1, 2""")
def correlation_matrix(spark, d):
    long = S.texts(spark, d).groupBy("genre", T.year_bin("year", 10).alias("period")).agg(F.count("*").cast("double").alias("n"))
    return V.correlations(long, "genre", "period", "n").withColumn("r", F.round("r", 6))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def linear_fit(spark, d):
    out = V.linear_fit(S.table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("""WITH c AS (SELECT l_returnflag AS g, l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag) AS u, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS v FROM lineitem),
s AS (SELECT g, count(*)::BIGINT AS n, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(u*v) AS t1, sum(u*u*v) AS t2, sum(v*v) AS tt FROM c GROUP BY g),
q AS (SELECT *, s4 - s2*s2/n AS q FROM s)
SELECT g AS l_returnflag, n, round((((t1*q - t2*s3) * t1 + (t2*s2 - t1*s3) * t2) / (s2*q - s3*s3)) / tt, 6) AS r2 FROM q""")
def quadratic_fit_r2(spark, d):
    return V.quadratic_fit(S.table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice").withColumn("r2", F.round("r2", 6))


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER w) / stddev_pop(p_retailprice) OVER w, 6) AS z FROM part WINDOW w AS (PARTITION BY p_brand)")
def zscore(spark, d):
    return V.z_scores(S.table(spark, d, "part"), "p_brand", "p_retailprice").select("p_partkey", F.round("z", 6).alias("z"))


@query()
def kmeans(spark, d):
    return V.clusters(S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v")), 8).select("vec_id", "cluster")


@query()
def classifier_cv(spark, d):
    docs = S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id")
    words = T.whitespace_words("text")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.log1p(F.size(words)).alias("f1"), (F.length("text") / F.greatest(F.size(words), F.lit(1))).alias("f2"), (F.length(F.regexp_replace("text", r"[\p{L}\s]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("f3"))
    return V.cross_validated(rows, ["f1", "f2", "f3"], "label")


@query()
def word2vec(spark, d):
    return V.word_vectors(S.table(spark, d, "conversations").select(T.tokens("text").alias("t")), "t", 16, 20)


MENTIONS = ["was", "that", "with", "les", "des", "und", "der", "los", "una", "it"]


@query(f"""WITH {TEXTS}, a AS (SELECT _id, {TOKENS} AS t FROM texts), m AS (SELECT _id, unnest(t) AS name, generate_subscripts(t, 1) AS pos FROM a),
k AS (SELECT * FROM m WHERE name IN ({', '.join(f"'{w}'" for w in MENTIONS)}))
SELECT least(x.name, y.name) AS src, greatest(x.name, y.name) AS dst, count(*)::BIGINT AS weight FROM k x JOIN k y ON x._id = y._id AND y.pos > x.pos AND y.pos - x.pos <= 5 AND x.name <> y.name GROUP BY 1, 2 HAVING count(*) >= 10""")
def comention_edges(spark, d):
    m = S.texts(spark, d).select(F.col("_id").alias("doc"), F.posexplode(T.tokens("text")).alias("pos", "name")).where(F.col("name").isin(*MENTIONS))
    return G.co_mentions(m, 5, 10)


def user_events(spark, d):
    return S.table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.col("event_type").alias("dst"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("t"))


EVENTS = "e AS (SELECT 'u' || user_id AS src, event_type AS dst, (ts::DATE - DATE '2024-01-01')::INTEGER AS t FROM events)"


@query(f"""WITH {EVENTS}, p AS (SELECT src, dst, t, count(*) AS n FROM e GROUP BY ALL)
SELECT src, dst, t, sum(n) OVER w::BIGINT AS weight, (t - lag(t) OVER w)::INTEGER AS since FROM p WINDOW w AS (PARTITION BY src, dst ORDER BY t)""")
def running_network(spark, d):
    return G.running(user_events(spark, d))


@query(f"WITH {EVENTS} SELECT src, dst, count(*)::BIGINT AS weight, max(t) AS last FROM e WHERE t <= 10 GROUP BY ALL")
def network_at_t(spark, d):
    return G.at_time(user_events(spark, d), 10)


@query(f"""WITH {EVENTS}, w AS (SELECT src, dst, count(*)::BIGINT AS weight FROM e GROUP BY ALL HAVING count(*) > 3), b AS (SELECT src, dst FROM w UNION SELECT dst, src FROM w), g AS (SELECT src AS node FROM b GROUP BY src HAVING count(*) >= 2)
SELECT src, dst, weight FROM w WHERE src IN (SELECT node FROM g) AND dst IN (SELECT node FROM g)""")
def degree_filter(spark, d):
    w = user_events(spark, d).groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return G.filtered(w, 3, 2).select("src", "dst", "weight")


@query()
def k_core(spark, d):
    e = S.table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    return G.k_core(e, 8)


@query("""WITH e AS (SELECT DISTINCT p_brand AS x, p_name AS y FROM part) SELECT a.x AS a, b.x AS b, count(*)::BIGINT AS shared FROM e a JOIN e b ON a.y = b.y AND a.x < b.x GROUP BY 1, 2 HAVING count(*) >= 30
UNION ALL SELECT a.y, b.y, count(*) FROM e a JOIN e b ON a.x = b.x AND a.y < b.y GROUP BY 1, 2 HAVING count(*) >= 30""")
def two_hop_overlap(spark, d):
    return G.two_hops(S.table(spark, d, "part").select(F.col("p_brand").alias("src"), F.col("p_name").alias("dst")), 30)


CHAIN = "c AS (SELECT DISTINCT conv_id AS src, conv_id + 1 + conv_id % 3 AS dst FROM conversations)"


@query(f"""WITH RECURSIVE {CHAIN}, r AS (SELECT src, dst, 1 AS hops FROM c UNION SELECT r.src, c.dst, r.hops + 1 FROM r JOIN c ON c.src = r.dst WHERE r.hops < 6)
SELECT src, dst, min(hops)::INTEGER AS hops FROM r GROUP BY src, dst""")
def closure(spark, d):
    c = S.table(spark, d, "conversations").select(F.col("conv_id").alias("src"), (F.col("conv_id") + 1 + F.col("conv_id") % 3).alias("dst"))
    return G.closure(c, 6)


@query(f"""WITH RECURSIVE {CHAIN}, b AS (SELECT src, dst FROM c UNION SELECT dst, src FROM c), r AS (SELECT src AS node, src AS seen FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON b.src = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY node""")
def connected_components(spark, d):
    c = S.table(spark, d, "conversations").select(F.col("conv_id").alias("src"), (F.col("conv_id") + 1 + F.col("conv_id") % 3).alias("dst"))
    return G.components(c.distinct())


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS t, role AS src, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations), p AS (SELECT src, dst, t, count(*) AS n FROM t WHERE dst IS NOT NULL GROUP BY ALL)
SELECT src, dst, t, sum(n) OVER w::BIGINT AS weight, t - lag(t) OVER w AS since FROM p WINDOW w AS (PARTITION BY src, dst ORDER BY t)""")
def letter_interactions(spark, d):
    from pyspark.sql import Window

    turns = S.table(spark, d, "conversations").withColumn("dst", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))).where("dst is not null")
    return G.running(turns.select(F.col("role").alias("src"), "dst", (F.col("conv_id") * 1000 + F.col("turn")).alias("t")))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 10")
def top_per_group(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id")
    return S.table(spark, d, "documents").select("lang", "doc_id", F.row_number().over(w).alias("n")).where("n <= 10").drop("n")


@query(f"""WITH {TEXTS}, n AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM texts GROUP BY genre)), r AS (SELECT _id, genre, row_number() OVER (PARTITION BY genre ORDER BY md5('0:' || _id), _id) AS place FROM texts)
SELECT _id, genre FROM r, n WHERE place <= least""")
def balanced_sample(spark, d):
    return V.balanced(S.texts(spark, d).select("_id", "genre"), "genre", "_id")
