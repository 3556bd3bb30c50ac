"""Queries over readers and sinks, scalar rules, curation and further word tables. What is written goes to the shared folder
and is read back from there."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import bibliography as B
from quire.functions import text as T
from quire.functions import udfs
from quire.operators import curation as U
from quire.operators import explore as X
from quire.operators import graph as G
from quire.operators import ingest as I
from quire.operators import semantics as M
from quire.operators import sets as Z
from quire.operators import similarity as V
from quire.operators import words as W
from quire.sources import readers as R
from quire.sources import scratch
from quire.sources import sinks as K
from quire.sources import tables as S

from .base import TEXTS, WORDS, query

# Readers and sinks


def _round_trip(spark, df, kind: str):
    path = scratch.new_path(spark, "sink") + "." + kind
    K.write(df, path)
    return R.metadata(spark, path)


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand FROM part")
def csv_round_trip(spark, d):
    out = _round_trip(spark, S.table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "csv")
    return out.select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_name", "p_brand")


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_type FROM part")
def tsv_round_trip(spark, d):
    out = _round_trip(spark, S.table(spark, d, "part").select("p_partkey", "p_name", "p_type"), "tsv")
    return out.select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_name", "p_type")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def jsonl_round_trip(spark, d):
    return _round_trip(spark, S.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "jsonl").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")


@query("SELECT n_nationkey AS key, CASE WHEN n_nationkey < 10 THEN 'old' ELSE n_name END AS name FROM nation UNION ALL SELECT 1000 + r_regionkey, r_name FROM region")
def upsert_by_id(spark, d):
    n = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    r = S.table(spark, d, "region").select((F.col("r_regionkey") + 1000).alias("key"), F.col("r_name").alias("name"))
    return K.upsert(n.where("key < 10").withColumn("name", F.lit("old")), n.unionByName(r), "key")


@query("SELECT '_' || p_type || '/x' AS corpus, count(*)::BIGINT AS n FROM part WHERE p_type <> 'PROMO' GROUP BY 1 UNION ALL SELECT '_PROMO/x', 1")
def corpus_replaced(spark, d):
    rows = S.parts(spark, d).select("_id", "corpus")
    path = scratch.new_path(spark, "corpora")
    K.replace_corpus(rows, path)
    K.replace_corpus(rows.where("corpus = 'PROMO'").limit(1), path)
    return spark.read.parquet(path).groupBy(F.concat(F.lit("_"), "corpus", F.lit("/x")).alias("corpus")).agg(F.count("*").alias("n"))


@query("SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'second' ELSE 'first' END AS value FROM nation WHERE n_nationkey % 5 <> 0")
def kv_last_value(spark, d):
    n = S.table(spark, d, "nation")
    path = scratch.new_path(spark, "keys")
    rows = lambda where, value, at: n.where(where).select(F.col("n_name").alias("key"), F.lit(value).cast("string").alias("value"), F.lit(at).alias("at"))
    rows("true", "first", 1.0).unionByName(rows("n_nationkey % 2 = 0", "second", 2.0)).unionByName(rows("n_nationkey % 5 = 0", None, 3.0)).write.parquet(path)
    return R.key_values(spark, path)


@query("SELECT lower(p_name) AS word, sum(p_size)::BIGINT AS count FROM part GROUP BY 1")
def tsv_frequencies(spark, d):
    path = scratch.new_path(spark, "frequencies")
    S.table(spark, d, "part").select(F.concat_ws("\t", "p_name", F.col("p_size").cast("string"))).write.text(path)
    return R.tsv_frequencies(spark, path)


@query("SELECT DISTINCT p_name AS old, p_type AS new FROM part")
def spelling_map(spark, d):
    path = scratch.new_path(spark, "spellings")
    S.table(spark, d, "part").select(F.concat_ws("\t", "p_name", "p_type")).distinct().write.text(path)
    return R.spelling_map(spark, path)


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'first' WHEN p_size % 3 = 1 THEN p_name END AS title, p_brand AS author FROM part")
def layered_metadata(spark, d):
    p = S.table(spark, d, "part")
    top = p.where("p_size % 3 < 2").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "first").otherwise("").alias("title"))
    base = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 != 2, F.col("p_name")).alias("title"), F.col("p_brand").alias("author"))
    return R.layered([top, base])


@query("SELECT p_partkey, nullif(CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END, '') AS title, CASE WHEN p_size % 2 = 0 THEN 1700 + p_size END::INTEGER AS year, CASE WHEN p_size % 2 = 1 THEN 'c. ' || (1700 + p_size) END AS year_orig FROM part")
def clean_metadata(spark, d):
    p = S.table(spark, d, "part")
    year = (F.lit(1700) + F.col("p_size")).cast("string")
    return R.clean_metadata(p.select("p_partkey", F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name")).alias("title"), F.when(F.col("p_size") % 2 == 0, year).otherwise(F.concat(F.lit("c. "), year)).alias("year")))


# Keys, ids and values


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type END AS value FROM part")
def prefixed_key(spark, d):
    meta = F.create_map(F.lit("title_main"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(""), F.lit("title_sub"), F.col("p_type"), F.lit("x"), F.lit("y"))
    return S.table(spark, d, "part").select("p_partkey", X.prefixed_key(meta, "title").alias("value"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE split_part(p_name || ' | x', '|', 1).trim() END AS value FROM part")
def ranked_key(spark, d):
    return S.table(spark, d, "part").select("p_partkey", X.ranked_key([F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" "), F.concat("p_name", F.lit(" | x"))]).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN printf('X%04d', row_number() OVER (PARTITION BY p_size % 10 = 0 ORDER BY p_partkey)) ELSE p_name END AS id FROM part")
def forced_ids(spark, d):
    p = S.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 10 != 0, F.col("p_name")).otherwise("").alias("id"))
    return I.forced_ids(p, [F.col("p_partkey")])


@query("SELECT p_partkey, CASE WHEN n > 1 THEN p_name || '/v' || n ELSE p_name END AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def versioned_ids(spark, d):
    return I.versioned_ids(S.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("id")), [F.col("p_partkey")])


@query("SELECT o_orderkey, [(1500 + o_orderkey % 300)::INTEGER, (1800 + o_orderkey % 100)::INTEGER] AS years, (1500 + o_orderkey % 300)::INTEGER AS year FROM orders")
def years_from_keys(spark, d):
    meta = F.create_map(F.lit("year_pub"), F.concat(F.lit("c. "), (1500 + F.col("o_orderkey") % 300).cast("string")), F.lit("date"), (1800 + F.col("o_orderkey") % 100).cast("string"), F.lit("other"), F.lit("1999"))
    o = S.table(spark, d, "orders").select("o_orderkey", B.years_of(meta).alias("years"))
    return o.withColumn("year", B.representative_year(F.col("years")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 1000)::VARCHAR WHEN o_orderkey % 3 = 1 THEN 'v' || o_orderkey ELSE (o_orderkey % 1000)::VARCHAR || '.5' END AS value FROM orders")
def numeric_coercion(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat((k % 1000).cast("string"), F.lit(".0"))).when(k % 3 == 1, F.concat(F.lit("v"), k.cast("string"))).otherwise(F.concat((k % 1000).cast("string"), F.lit(".50")))
    return S.table(spark, d, "orders").select("o_orderkey", B.coerced(raw).alias("value"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Female' ELSE 'Indeterminate' END AS gender FROM customer")
def gender_values(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in (" male", "F", "woman", "?")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return S.table(spark, d, "customer").select("c_custkey", T.gender(raw).alias("gender"))


@query("SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') AS key, trim(c_name, '#0123456789') AS name, 'a joined' AS line FROM customer")
def string_rules(spark, d):
    c = S.table(spark, d, "customer")
    return c.select("c_custkey", T.alnum("c_name").alias("key"), F.btrim("c_name", F.lit("#0123456789")).alias("name"), T.hyphens_joined(F.lit("a joi¬ \n ned")).alias("line"))


@query("SELECT p_partkey, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS key FROM part")
def title_keys(spark, d):
    return S.table(spark, d, "part").select("p_partkey", T.title_key("p_name").alias("key"))


@query("""WITH t AS (SELECT p_partkey, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS t FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Mr. ' || t ELSE t END AS short FROM t""")
def short_titles(spark, d):
    k = F.col("p_partkey") % 3
    title = F.when(k == 0, F.concat(F.lit("mr. "), "p_name", F.lit(": a tale"))).when(k == 1, F.concat("p_name", F.lit(" a novel"))).otherwise(F.concat("p_name", F.lit("; or the rest")))
    return S.table(spark, d, "part").select("p_partkey", T.short_title(title).alias("short"))


@query("SELECT page_id, regexp_extract(html, '(?s)<p\\b[^>]*>(.*?)</p>', 1) AS text FROM pages")
def tag_substring(spark, d):
    return S.table(spark, d, "pages").select("page_id", T.tag_text("html", "p").alias("text"))


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '([\\p{L}\\p{N}'']+|[^\\p{L}\\p{N}'']+)'))::INTEGER AS n FROM conversations")
def agnostic_tokens(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", F.size(T.agnostic_tokens("text")).alias("n"))


@query("SELECT conv_id, turn, (len(regexp_extract_all(lower(text), 'th')))::INTEGER AS n, (instr(lower(text), 'th') - 1)::INTEGER AS first FROM conversations WHERE contains(lower(text), 'th')")
def phrase_index(spark, d):
    c = S.table(spark, d, "conversations").select("conv_id", "turn", T.phrase_places("text", "th").alias("p")).where("size(p) > 0")
    return c.select("conv_id", "turn", F.size("p").alias("n"), F.col("p")[0]["start"].alias("first"))


@query("SELECT p_partkey, [p_name, p_name || 'e'] AS spellings FROM part")
def spelling_variants(spark, d):
    words = F.split("p_name", " ")
    last = F.element_at(words, -1)
    return S.table(spark, d, "part").select("p_partkey", B.variants(words, F.create_map(last, F.array(last, F.concat(last, F.lit("e"))))).alias("spellings"))


@query("SELECT p_partkey, '(' || replace(p_name, ' ', ', ') || '.)' AS text FROM part")
def detokenised(spark, d):
    words = F.concat(F.array(F.lit("(")), F.split(F.replace("p_name", F.lit(" "), F.lit(" , ")), " "), F.array(F.lit("."), F.lit(")")))
    return S.table(spark, d, "part").select("p_partkey", B.detokenised(words).alias("text"))


@query("SELECT p_partkey, [p_name, p_brand, p_type] AS x, p_type AS last FROM part")
def appended_sets(spark, d):
    p = S.table(spark, d, "part")
    return p.select("p_partkey", Z.appended(F.array("p_name", "p_brand"), F.array("p_brand", "p_type")).alias("x"), Z.last_non_empty(F.col("p_name"), F.col("p_type"), F.lit(" ")).alias("last"))


@query("SELECT _id, year FROM (SELECT '_' || p_type || '/' || p_partkey AS _id, (1900 + p_size)::INTEGER AS year, p_type FROM part) ORDER BY year, _id LIMIT 50")
def sorted_by_year(spark, d):
    return S.parts(spark, d).select("_id", "year").orderBy(F.col("year").asc_nulls_last(), "_id").limit(50)


@query("SELECT p_partkey, p_type IN ('PROMO', 'ECONOMY') AS fiction FROM part")
def fiction_flag(spark, d):
    genres = F.when(F.col("p_type") == "PROMO", F.array(F.lit("Fiction"), F.lit("Sermon"))).when(F.col("p_type") == "ECONOMY", F.array(F.lit("Novel"))).otherwise(F.array(F.lit("Poetry")))
    return S.table(spark, d, "part").select("p_partkey", B.is_fiction(genres).alias("fiction"))


# Curation

PAIRS = """pairs AS (SELECT '_p/' || lpad(p_partkey::VARCHAR, 9, '0') AS a, '_p/' || lpad((p_partkey + 1)::VARCHAR, 9, '0') AS b, 0.5::DOUBLE AS similarity, 'fuzzy_title' AS tier, p_partkey AS k FROM part)"""


def _pairs(spark, d):
    name = lambda c: F.concat(F.lit("_p/"), F.lpad(c.cast("string"), 9, "0"))
    k = F.col("p_partkey")
    return S.table(spark, d, "part").select(name(k).alias("a"), name(k + 1).alias("b"), F.lit(0.5).alias("similarity"), F.lit("fuzzy_title").alias("tier"), k.alias("k"))


@query(f"WITH {PAIRS} SELECT a, b, CASE WHEN k % 3 = 0 THEN 1.0 ELSE similarity END::DOUBLE AS similarity, CASE WHEN k % 3 = 0 THEN 'manual' ELSE tier END AS tier FROM pairs")
def manual_links(spark, d):
    p = _pairs(spark, d)
    return U.link(p.drop("k"), p.where("k % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b")))


@query(f"WITH {PAIRS} SELECT a, b, similarity, tier FROM pairs WHERE k % 4 <> 0")
def manual_unlinks(spark, d):
    p = _pairs(spark, d)
    return U.unlink(p.drop("k"), p.where("k % 4 = 0").select("b", "a"))


ANNOTATED = """o AS (SELECT '_d/' || doc_id AS _id, doc_id, lang FROM documents), a AS (SELECT _id, 'human' AS source, 'genre' AS col, CASE WHEN lang = 'en' THEN 'Letters' ELSE 'Sermon' END AS val, CASE WHEN lang = 'en' THEN 2 ELSE 1 END::BIGINT AS seq FROM o WHERE doc_id % 7 <> 0)"""


def _annotations(spark, d):
    o = S.table(spark, d, "documents").select(F.concat(F.lit("_d/"), F.col("doc_id").cast("string")).alias("_id"), "doc_id", "lang")
    first = U.bulk(o, F.lit(True), "human", "genre", "Sermon", 1)
    later = U.annotate(first, U.bulk(o, F.col("lang") == "en", "human", "genre", "Letters", 2))
    return U.annotate(later, o.where("doc_id % 7 = 0").select("_id", F.lit("human").alias("source"), F.lit("genre").alias("col"), F.lit(None).cast("string").alias("val"), F.lit(3).cast("long").alias("seq")))


@query(f"WITH {ANNOTATED} SELECT * FROM a")
def annotations_upserted(spark, d):
    return _annotations(spark, d)


@query(f"WITH {ANNOTATED} SELECT source, col, val, count(*)::BIGINT AS n, count(DISTINCT _id)::BIGINT AS n_texts FROM a GROUP BY ALL")
def annotation_stats(spark, d):
    return U.annotation_stats(_annotations(spark, d))


@query("""SELECT '_c/' || c_custkey AS a, '_s/' || s_suppkey AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey
WHERE 1 - levenshtein(replace(c_name, 'Customer', 'X'), replace(s_name, 'Supplier', 'X')) / greatest(length(replace(c_name, 'Customer', 'X')), length(replace(s_name, 'Supplier', 'X')), 1) >= 0.8""")
def linkage_of_two(spark, d):
    c = S.table(spark, d, "customer").select(F.concat(F.lit("_c/"), F.col("c_custkey").cast("string")).alias("_id"), F.replace("c_name", F.lit("Customer"), F.lit("X")).alias("name"), F.col("c_nationkey").alias("nation"))
    s = S.table(spark, d, "supplier").select(F.concat(F.lit("_s/"), F.col("s_suppkey").cast("string")).alias("_id"), F.replace("s_name", F.lit("Supplier"), F.lit("X")).alias("name"), F.col("s_nationkey").alias("nation"))
    return U.linkage_between(c, s, "nation", ["name"], 0.8)


SIGNATURE = """g AS (SELECT p_brand, list_distinct(list(p_name)) AS w FROM part GROUP BY p_brand),
s AS (SELECT p_brand, list_transform(range(0, 8), lambda k: list_min(list_transform(w, lambda x: ('0x' || substr(md5(k || ':' || x), 1, 15))::BIGINT))) AS signature FROM g)"""


def _signatures(spark, d):
    return S.table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("w")).select("p_brand", U.minhash(F.col("w")).alias("signature"))


@query(f"WITH {SIGNATURE} SELECT p_brand, signature FROM s")
def minhash_signature(spark, d):
    return _signatures(spark, d)


@query(f"WITH {SIGNATURE} SELECT a.p_brand AS a, b.p_brand AS b, (len(list_filter(range(1, 9), lambda k: a.signature[k] = b.signature[k])) / 8.0)::DOUBLE AS similarity FROM s a JOIN s b ON a.p_brand < b.p_brand")
def minhash_similarity(spark, d):
    s = _signatures(spark, d)
    a, b = s.toDF("a", "x"), F.broadcast(s.toDF("b", "y"))  # brands are few
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", U.minhash_similarity(F.col("x"), F.col("y")).alias("similarity"))


# Words


@query(f"""WITH {WORDS} SELECT _id, word, "count" AS raw, 1 AS presence, round("count" / sum("count") OVER w, 6) AS share, round("count" * 1000000.0::DOUBLE / sum("count") OVER w, 4) AS per_million FROM word_index WINDOW w AS (PARTITION BY _id)""")
def freq_modes(spark, d):
    return W.modes(S.stored_index(spark, d)).withColumn("share", F.round("share", 6)).withColumn("per_million", F.round("per_million", 4))


@query(f"""WITH {WORDS}, l AS (SELECT _id, word, "count" / sum("count") OVER (PARTITION BY _id) AS tf FROM word_index) SELECT _id, word, CASE WHEN min(tf) OVER (PARTITION BY word) >= 1 THEN tf ELSE floor(tf * 1000000) END::BIGINT AS scaled FROM l""")
def scaled_counts(spark, d):
    tf = W.modes(S.stored_index(spark, d)).select("_id", "word", F.col("share").alias("tf"))
    return W.scaled_counts(tf, "tf").select("_id", "word", "scaled")


@query(f"""WITH {WORDS} SELECT author, word, sum("count")::BIGINT AS n, count(*)::BIGINT AS n_texts FROM word_index JOIN (SELECT _id, author FROM texts) USING (_id) GROUP BY ALL""")
def author_words(spark, d):
    return W.author_index(S.stored_index(spark, d), S.texts(spark, d))


# Vectors and networks


@query("SELECT 'l' || label AS word FROM embeddings GROUP BY label HAVING count(*) >= 10 ORDER BY count(*) DESC, word LIMIT 5")
def limited_vocabulary(spark, d):
    e = S.table(spark, d, "embeddings").withColumn("word", F.concat(F.lit("l"), F.col("label").cast("string")))
    vectors = V.gathered(V.centroids(e, "word", "embedding"), "word")
    return M.limited(vectors, e.groupBy("word").agg(F.count("*").alias("n")), 10, 5).select("word")


@query("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT v AS u FROM x WHERE vec_id = (SELECT min(vec_id) FROM x))
SELECT vec_id, round(sqrt(greatest(list_dot_product(v, v) - list_dot_product(v, u) ** 2 / list_dot_product(u, u), 0)), 4) AS length FROM x, b""")
def vector_rejection(spark, d):
    e = S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    base = e.orderBy("vec_id").limit(1).select(F.col("v").alias("u"))
    return e.join(F.broadcast(base)).select("vec_id", F.round(V.norm(V.rejected(F.col("v"), F.col("u"))), 4).alias("length"))  # one row


@query("""WITH e AS (SELECT DISTINCT p_brand AS src, p_type AS dst FROM part), w AS (SELECT p_brand AS src, p_type AS dst, count(*)::DOUBLE AS weight FROM part GROUP BY ALL) SELECT src, dst, round(greatest(1.0, weight * 10.0 / (SELECT max(weight) FROM w)), 6) AS weight FROM w""")
def rescaled_weights(spark, d):
    w = S.table(spark, d, "part").groupBy(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return G.rescaled(w, 10.0).withColumn("weight", F.round("weight", 6))


@query("""WITH e AS (SELECT DISTINCT p_brand AS src, p_type AS dst FROM part), p AS (SELECT src AS node, 'b' || length(src) AS part FROM e UNION SELECT dst, 't' || substr(dst, 1, 1) FROM e)
SELECT least(x.part, y.part) AS a, greatest(x.part, y.part) AS b, count(*)::BIGINT AS n FROM e JOIN p x ON x.node = src JOIN p y ON y.node = dst GROUP BY 1, 2""")
def block_model(spark, d):
    e = S.table(spark, d, "part").select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")).distinct()
    parts = e.select(F.col("src").alias("node"), F.concat(F.lit("b"), F.length("src").cast("string")).alias("part")).union(e.select("dst", F.concat(F.lit("t"), F.substring("dst", 1, 1)))).distinct()
    return M.blocks(e, parts)


@query("SELECT p_brand AS src, p_type AS dst FROM part UNION ALL SELECT p_name, p_type FROM part UNION ALL SELECT p_type, p_brand FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_type, p_name FROM part WHERE p_size % 2 = 0")
def dynamic_network(spark, d):
    line = F.concat("p_brand", F.lit(", "), "p_name", F.when(F.col("p_size") % 2 == 0, " <> ").otherwise(" > "), "p_type")
    return G.dynamic_edges(S.table(spark, d, "part").select(line.alias("line")), "line")


@query("SELECT p_brand AS src, 'kin' AS rel, p_name AS dst, 'a' AS meta FROM part UNION ALL SELECT p_brand, '', p_type, '' FROM part")
def static_network(spark, d):
    line = F.concat("p_brand", F.lit(" --> (kin)"), "p_name", F.lit("[a]; "), "p_type")
    return G.static_edges(S.table(spark, d, "part").select(line.alias("line")), "line")


@query("SELECT (sum(CASE WHEN p >= 0.5 AND label = 1 THEN 1 ELSE 0 END) / sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END))::DOUBLE AS precision, (sum(CASE WHEN p >= 0.5 AND label = 1 THEN 1 ELSE 0 END) / sum(label))::DOUBLE AS recall, (2 * sum(CASE WHEN p >= 0.5 AND label = 1 THEN 1 ELSE 0 END) / (sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) + sum(label)))::DOUBLE AS f1 FROM (SELECT p_size % 2 AS label, p_size / 50.0 AS p FROM part)")
def prediction_report(spark, d):
    return V.report(S.table(spark, d, "part").select((F.col("p_size") % 2).alias("label"), (F.col("p_size") / 50).alias("p")))


@query(f"""WITH {TEXTS}, r AS (SELECT _id, CASE WHEN year % 5 = 0 THEN '' ELSE genre END AS genre, CASE WHEN year % 2 = 0 THEN '_' || corpus || '/' || (id::BIGINT - id::BIGINT % 10) END AS of, genre AS own, year FROM texts)
SELECT r._id, CASE WHEN r.genre <> '' THEN r.genre ELSE s.genre END AS genre FROM r LEFT JOIN r s ON s._id = r.of""")
def inherited_columns(spark, d):
    from quire.operators import links as L

    t = S.texts(spark, d)
    near = F.concat(F.lit("_"), "corpus", F.lit("/"), (F.col("id").cast("long") - F.col("id").cast("long") % 10).cast("string"))
    r = t.select("_id", F.when(F.col("year") % 5 == 0, "").otherwise(F.col("genre")).alias("genre"), F.when(F.col("year") % 2 == 0, near).alias("of"))
    return L.inherited(r, "_id", "of", ["genre"]).select("_id", "genre")


ROMAN = ["i", "iv", "ix", "xiv", "xl", "xc", "cd", "mdcclxxvi"]


@query("SELECT s_suppkey, [1, 4, 9, 14, 40, 90, 400, 1776][(s_suppkey % 8 + 1)::INT]::INTEGER AS pages FROM supplier")
def roman_pages(spark, d):
    raw = F.concat(F.element_at(F.array(*[F.lit(x) for x in ROMAN]), (F.col("s_suppkey") % 8 + 1).cast("int")), F.lit(" p."))
    return S.table(spark, d, "supplier").select("s_suppkey", udfs.extent(raw)["num_pages"].cast("int").alias("pages"))
