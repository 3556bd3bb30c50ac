"""Linkage, grouping, enrichment, curation and link queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import links as L
from quire.operators import matching as M
from quire.operators import sets as Z
from quire.sources import tables as S

from .base import TEXTS, query

RECORDS = """rec AS (
  SELECT '_' || p_type || '/' || p_partkey AS _id, p_type AS corpus, p_name || ' of quality' || CASE WHEN p_partkey % 3 = 0 THEN ' and other goods' ELSE '' END AS title_norm,
    CASE WHEN p_partkey % 5 <> 0 THEN lower(p_brand) END AS author_norm, (1900 + p_size)::INTEGER AS year, p_partkey FROM part)"""


def records(spark, d):
    p = S.parts(spark, d)
    key = F.col("id").cast("long")
    title = F.concat("title", F.lit(" of quality"), F.when(key % 3 == 0, " and other goods").otherwise(""))
    author = F.when(key % 5 != 0, F.col("author"))
    return p.select("_id", "corpus", T.normalize_title(title).alias("title_norm"), T.normalize_author(author).alias("author_norm"), "year", key.alias("p_partkey"))


def rounded(pairs):
    return pairs.withColumn("similarity", F.round("similarity", 6))


ID = """SELECT least('_customer/' || c_custkey, '_supplier/' || s_suppkey) AS a, greatest('_customer/' || c_custkey, '_supplier/' || s_suppkey) AS b, 1.0::DOUBLE AS similarity, 'id_link' AS tier
FROM customer JOIN supplier ON c_custkey = s_suppkey"""
EXACT = """SELECT a, b, 1.0::DOUBLE AS similarity, 'exact_norm' AS tier FROM (SELECT _id AS a, lead(_id) OVER (PARTITION BY title_norm, author_norm ORDER BY _id) AS b FROM rec WHERE length(title_norm) > 5 AND author_norm IS NOT NULL) WHERE b IS NOT NULL"""
EXACT_YEAR = """SELECT a, b, 1.0::DOUBLE AS similarity, 'exact_norm_year' AS tier FROM (SELECT _id AS a, lead(_id) OVER (PARTITION BY title_norm, year ORDER BY _id) AS b FROM rec WHERE length(title_norm) > 10 AND author_norm IS NULL) WHERE b IS NOT NULL"""


def _held(block: str, least: int, where: str, tier: str) -> str:
    return f"""SELECT x._id AS a, y._id AS b, round(least(length(x.title_norm), length(y.title_norm)) / greatest(length(x.title_norm), length(y.title_norm)), 6) AS similarity, '{tier}' AS tier
FROM rec x JOIN rec y ON x.{block} = y.{block} AND x._id < y._id AND x.corpus <> y.corpus
WHERE x.{block} IN (SELECT {block} FROM rec WHERE {where} AND length(title_norm) >= {least} GROUP BY {block} HAVING count(*) BETWEEN 2 AND 500)
  AND x.{where} AND y.{where} AND length(x.title_norm) >= {least} AND length(y.title_norm) >= {least} AND x.title_norm <> y.title_norm
  AND least(length(x.title_norm), length(y.title_norm)) / greatest(length(x.title_norm), length(y.title_norm)) >= 0.3
  AND (contains(x.title_norm, y.title_norm) OR contains(y.title_norm, x.title_norm))"""


HELD = _held("author_norm", 8, "author_norm IS NOT NULL", "containment")
HELD_YEAR = _held("year", 15, "author_norm IS NULL", "containment_year")
FUZZY = """SELECT x._id AS a, y._id AS b, round(jaro_winkler_similarity(x.title_norm, y.title_norm), 6) AS similarity, 'fuzzy_title' AS tier
FROM rec x JOIN rec y ON x.author_norm = y.author_norm AND x._id < y._id AND x.corpus <> y.corpus AND abs(x.year - y.year) <= 20
WHERE x.author_norm IN (SELECT author_norm FROM rec GROUP BY 1 HAVING count(*) BETWEEN 2 AND 200) AND jaro_winkler_similarity(x.title_norm, y.title_norm) > 0.85"""
LINK = """SELECT least(x._id, y._id) AS a, greatest(x._id, y._id) AS b, 1.0::DOUBLE AS similarity, 'id_link' AS tier FROM rec x JOIN rec y ON y.p_partkey = x.p_partkey + 1 WHERE x.p_partkey % 7 = 0"""
ALL = f"""tiers AS (SELECT *, 0 AS t FROM ({LINK}) UNION ALL SELECT *, 5 FROM ({FUZZY}) UNION ALL SELECT *, 1 AS t FROM ({EXACT}) UNION ALL SELECT *, 2 FROM ({EXACT_YEAR}) UNION ALL SELECT *, 3 FROM ({HELD}) UNION ALL SELECT *, 4 FROM ({HELD_YEAR})),
pairs AS (SELECT a, b, arg_min(similarity, t) AS similarity, arg_min(tier, t) AS tier FROM tiers GROUP BY a, b)"""


@query(ID)
def match_id_link(spark, d):
    c = S.table(spark, d, "customer").select(F.concat(F.lit("_customer/"), F.col("c_custkey").cast("string")).alias("_id"), F.col("c_custkey").cast("string").alias("key"))
    s = S.table(spark, d, "supplier").select(F.concat(F.lit("_supplier/"), F.col("s_suppkey").cast("string")).alias("_id"), F.col("s_suppkey").cast("string").alias("key"))
    return M.id_link(c, s)


@query(f"WITH {RECORDS} {EXACT}")
def match_exact_chain(spark, d):
    return M.exact(records(spark, d))


@query(f"WITH {RECORDS} {EXACT_YEAR}")
def match_exact_year_chain(spark, d):
    return M.exact_year(records(spark, d))


@query(f"WITH {RECORDS} {HELD}")
def match_containment(spark, d):
    return rounded(M.containment(records(spark, d)))


@query(f"WITH {RECORDS} {HELD_YEAR}")
def match_containment_year(spark, d):
    return rounded(M.containment_year(records(spark, d)))


@query(f"WITH {RECORDS} {FUZZY}")
def match_fuzzy(spark, d):
    return rounded(M.fuzzy(records(spark, d)))


def tiers(spark, d):
    """All tiers in their order; every seventh record declares the next one's key."""
    r = records(spark, d)
    links = M.id_link(r.where("p_partkey % 7 = 0").select("_id", (F.col("p_partkey") + 1).cast("string").alias("key")), r.select("_id", F.col("p_partkey").cast("string").alias("key")))
    return M.first_tier(links, M.exact(r), M.exact_year(r), M.containment(r), M.containment_year(r), M.fuzzy(r))


@query(f"WITH {RECORDS}, {ALL} SELECT * FROM pairs")
def match_all_tiers(spark, d):
    return rounded(tiers(spark, d))


def exact_groups(spark, d):
    r = records(spark, d)
    rank = F.when(F.col("_id").startswith("_ECONOMY/"), 1).otherwise(1000)
    return M.groups(M.first_tier(M.exact(r), M.exact_year(r)), rank)


GROUPS = f"""edges AS (SELECT a, b FROM ({EXACT}) UNION SELECT a, b FROM ({EXACT_YEAR})), both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
walk AS (SELECT a AS _id, a AS seen FROM both_ UNION SELECT w._id, e.b FROM walk w JOIN both_ e ON e.a = w.seen),
comps AS (SELECT _id, min(seen) AS "group" FROM walk GROUP BY _id),
groups AS (SELECT *, (row_number() OVER (PARTITION BY "group" ORDER BY CASE WHEN _id LIKE '\\_ECONOMY/%' ESCAPE '\\' THEN 1 ELSE 1000 END, _id) - 1)::INTEGER AS rank FROM comps)"""


@query(f"WITH RECURSIVE {RECORDS}, {GROUPS} SELECT * FROM groups")
def match_groups(spark, d):
    return exact_groups(spark, d)


@query(f'WITH RECURSIVE {RECORDS}, {GROUPS} SELECT size, count(*)::BIGINT AS n_groups FROM (SELECT "group", count(*)::BIGINT AS size FROM groups GROUP BY 1) GROUP BY size')
def match_stats(spark, d):
    return M.group_stats(exact_groups(spark, d))


@query(f"WITH {RECORDS}, {ALL} SELECT tier, count(*)::BIGINT AS n FROM pairs GROUP BY tier")
def match_types(spark, d):
    return tiers(spark, d).groupBy("tier").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {RECORDS}, {GROUPS} SELECT _id, \"group\", rank, title_norm AS title FROM groups JOIN rec USING (_id) WHERE \"group\" IN (SELECT \"group\" FROM groups JOIN rec USING (_id) WHERE title_norm ILIKE '%ring%')")
def find_matches(spark, d):
    r = records(spark, d).select("_id", F.col("title_norm").alias("title"))
    return M.found(exact_groups(spark, d), r, "ring").select("_id", "group", "rank", "title")


@query(f"WITH RECURSIVE {RECORDS}, {GROUPS} SELECT _id, \"group\", rank, title_norm, year FROM groups JOIN rec USING (_id) WHERE \"group\" IN (SELECT \"group\" FROM groups JOIN rec USING (_id) WHERE p_partkey = 9)")
def get_group(spark, d):
    r = records(spark, d)
    own = r.where("p_partkey = 9").select("_id")
    g = exact_groups(spark, d)
    return g.join(g.join(own, "_id", "left_semi").select("group"), "group", "left_semi").join(r.select("_id", "title_norm", "year"), "_id").select("_id", "group", "rank", "title_norm", "year")


@query(f"WITH {RECORDS}, {ALL} SELECT corpus_a, corpus_b, count(*)::BIGINT AS n FROM (SELECT regexp_extract(a, '^_([^/]*)/', 1) AS corpus_a, regexp_extract(b, '^_([^/]*)/', 1) AS corpus_b FROM pairs) WHERE corpus_a <> corpus_b GROUP BY 1, 2")
def corpus_overlap(spark, d):
    return M.overlap(tiers(spark, d))


@query("""SELECT '_c/' || x.c_custkey AS a, '_c/' || y.c_custkey AS b FROM customer x JOIN customer y ON x.c_nationkey = y.c_nationkey AND '_c/' || x.c_custkey < '_c/' || y.c_custkey AND x.c_mktsegment = y.c_mktsegment
WHERE 1 - levenshtein(x.c_name, y.c_name) / greatest(length(x.c_name), length(y.c_name)) >= 0.9""")
def blocked_linkage(spark, d):
    c = S.table(spark, d, "customer").select(F.concat(F.lit("_c/"), F.col("c_custkey").cast("string")).alias("_id"), "c_name", "c_nationkey", "c_mktsegment")
    return M.linkage(c, "c_nationkey", ["c_name"], 0.9, ("c_mktsegment",))


@query(f"""WITH RECURSIVE {RECORDS}, {GROUPS}, base AS (SELECT _id, corpus, CASE WHEN corpus = 'ECONOMY' THEN 'Fiction' WHEN p_partkey % 4 = 0 THEN NULL ELSE 'Poetry' END AS genre,
  CASE WHEN corpus <> 'ECONOMY' AND p_partkey % 2 = 0 THEN 'Verse' END AS genre_raw, CASE WHEN p_partkey % 7 = 0 THEN 'form' END AS meta_source FROM rec),
src AS (SELECT b.*, "group", genre AS genre_corpus, coalesce(meta_source, CASE WHEN genre IS NOT NULL THEN 'corpus' END) AS gs FROM base b LEFT JOIN groups USING (_id)),
chosen AS (SELECT "group", arg_min(genre, _id) AS g FROM src WHERE corpus = 'ECONOMY' AND "group" IS NOT NULL GROUP BY 1),
t AS (SELECT src.*, g, coalesce(g IS NOT NULL AND (genre IS NULL OR genre <> g OR gs IN ('corpus', 'form', 'title', 'topic')), false) AS takes FROM src LEFT JOIN chosen USING ("group"))
SELECT _id, CASE WHEN takes THEN g ELSE genre END AS genre, CASE WHEN takes AND genre_raw = 'Verse' THEN NULL ELSE genre_raw END AS genre_raw, genre_corpus,
  CASE WHEN corpus = 'ECONOMY' OR takes THEN 'bibliography:ECONOMY' ELSE gs END AS genre_source FROM t""")
def enrich_genres(spark, d):
    r = records(spark, d)
    genre = F.when(F.col("corpus") == "ECONOMY", "Fiction").when(F.col("p_partkey") % 4 == 0, None).otherwise("Poetry")
    t = r.select("_id", "corpus", genre.alias("genre"), F.when((F.col("corpus") != "ECONOMY") & (F.col("p_partkey") % 2 == 0), "Verse").alias("genre_raw"), F.when(F.col("p_partkey") % 7 == 0, "form").alias("meta_source"), F.lit(None).cast("string").alias("linked_source"))
    return M.enriched(t, exact_groups(spark, d), {"ECONOMY": 10}).select("_id", "genre", "genre_raw", "genre_corpus", "genre_source")


ANNOTATIONS = """anno AS (SELECT '_' || source || '/' || doc_id AS _id, 'human' AS source, 'genre' AS col, CASE WHEN toxic = 1 THEN '__none__' ELSE 'Sermon' END AS val, doc_id AS seq FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 OR quality = 0
  UNION ALL SELECT '_' || source || '/' || doc_id, 'machine', 'genre', 'Letters', doc_id FROM labels JOIN documents USING (doc_id) WHERE doc_id % 2 = 0),
flat AS (SELECT _id, col, arg_min(val, CASE source WHEN 'human' THEN 1 ELSE 2 END) AS val, arg_min(source, CASE source WHEN 'human' THEN 1 ELSE 2 END) AS source FROM anno GROUP BY _id, col)"""


def annotations(spark, d):
    j = S.table(spark, d, "labels").join(S.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    id_ = F.concat(F.lit("_"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    human = j.where("toxic = 1 or quality = 0").select(id_.alias("_id"), F.lit("human").alias("source"), F.lit("genre").alias("col"), F.when(F.col("toxic") == 1, "__none__").otherwise("Sermon").alias("val"), F.col("doc_id").alias("seq"))
    machine = j.where("doc_id % 2 = 0").select(id_.alias("_id"), F.lit("machine").alias("source"), F.lit("genre").alias("col"), F.lit("Letters").alias("val"), F.col("doc_id").alias("seq"))
    return M.flattened(human.unionByName(machine), ["human", "machine"])


@query(f"WITH {ANNOTATIONS} SELECT * FROM flat")
def annotations_flatten(spark, d):
    return annotations(spark, d)


@query(f"WITH {ANNOTATIONS}, {TEXTS} SELECT texts._id, CASE WHEN val = '__none__' THEN NULL ELSE coalesce(val, genre) END AS genre FROM texts LEFT JOIN flat ON flat._id = texts._id")
def annotations_apply(spark, d):
    return M.overridden(S.texts(spark, d).select("_id", "genre"), annotations(spark, d), "genre")


@query(f"""WITH {ANNOTATIONS}, {TEXTS}, g AS (SELECT _id, title || chr(1) || author AS "group" FROM texts), own AS (SELECT "group", arg_min(val, _id) AS val FROM flat JOIN g USING (_id) GROUP BY 1)
SELECT _id, val FROM g JOIN own USING ("group") WHERE _id NOT IN (SELECT _id FROM flat)""")
def annotations_propagate(spark, d):
    g = S.texts(spark, d).select("_id", F.concat("title", F.lit("\u0001"), "author").alias("group"))
    return M.propagated(annotations(spark, d), g, "genre")


@query(f"WITH {ANNOTATIONS}, {TEXTS} SELECT _id, genre FROM texts WHERE corpus = 'src1' OR _id IN (SELECT _id FROM flat)")
def whitelist_union(spark, d):
    t = S.texts(spark, d).select("_id", "corpus", "genre")
    return M.whitelisted(t.where("corpus = 'src1'"), t, annotations(spark, d).select("_id")).select("_id", "genre")


@query("SELECT c_custkey, c_name, c_nationkey, n_name AS nation_name, n_regionkey AS nation_regionkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def linked_left_merge(spark, d):
    n = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("regionkey"))
    return L.linked(S.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), n, "c_nationkey", "key", "nation").drop("nation_key")


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n, min(o_orderkey) AS first FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def linked_one_to_many(spark, d):
    many = L.one_to_many(S.table(spark, d, "customer").select("c_custkey"), S.table(spark, d, "orders").select("o_custkey", "o_orderkey"), "c_custkey", "o_custkey")
    return many.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.min("o_orderkey").alias("first"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(p.p_name, s.s_name) AS name FROM lineitem LEFT JOIN part p ON p.p_partkey = l_partkey AND p.p_size > 25 LEFT JOIN supplier s ON s.s_suppkey = l_suppkey""")
def two_key_coalesce_join(spark, d):
    li = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = S.table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("k1"), F.col("p_name").alias("v"))
    s = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k2"), F.col("s_name").alias("v"))
    s = s.union(s.select("k2", F.concat("v", F.lit(" again"))))  # a key that repeats
    return L.coalesced(li, [(p, "l_partkey", "k1"), (s, "l_suppkey", "k2")], "v").select("l_orderkey", "l_linenumber", F.col("v").alias("name"))


@query("""SELECT c_custkey, (SELECT arg_max(p, length(p)) FROM (SELECT DISTINCT left(c_name, 15) AS p FROM customer WHERE c_custkey % 2 = 0 UNION SELECT DISTINCT left(c_name, 17) FROM customer WHERE c_custkey % 3 = 0) q WHERE starts_with(c_name, p)) AS prefix
FROM (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey < 20)""")
def prefix_shelfmark_join(spark, d):
    c = S.table(spark, d, "customer").select("c_custkey", "c_name")
    codes = c.where("c_custkey % 2 = 0").select(F.substring("c_name", 1, 15).alias("prefix")).union(c.where("c_custkey % 3 = 0").select(F.substring("c_name", 1, 17))).distinct()
    c = c.union(c.where("c_custkey < 20"))  # rows that repeat, and rows without a code, stay
    return L.longest_prefix(c, "c_name", codes, "prefix", (15, 17)).select("c_custkey", "prefix")


@query("SELECT doc_id, CASE WHEN quality = 0 THEN '' WHEN quality = 1 THEN 'v' || doc_id ELSE source END AS linked FROM documents LEFT JOIN labels USING (doc_id)")
def verified_override(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", F.col("source").alias("linked"))
    human = S.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "n").otherwise("y").alias("is_match"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("verified"))
    return L.verified(docs, human, "doc_id", "linked")


@query("""WITH c AS (SELECT x.c_custkey AS a, y.c_custkey AS b, jaro_winkler_similarity(x.c_name, y.c_name) AS s FROM customer x JOIN customer y ON x.c_nationkey = y.c_nationkey AND x.c_mktsegment = y.c_mktsegment AND x.c_custkey <> y.c_custkey
WHERE x.c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND jaro_winkler_similarity(x.c_name, y.c_name) >= 0.85), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM c) SELECT a, b, round(s, 6) AS score FROM r WHERE n = 1""")
def candidates_to_verify(spark, d):
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title"), F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("block"))
    done = S.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    return L.to_verify(c, c, done, "key", "title", "block").withColumn("score", F.round("score", 6))


@query("SELECT c_custkey AS key, c_name AS name, 'customer' AS corpus FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def union_corpora(spark, d):
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    s = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return Z.union({"customer": c, "supplier": s})


@query("SELECT p_name AS name, count(*)::BIGINT AS n FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_brand = 'Brand#2') AND p_name IN (SELECT p_name FROM part WHERE p_brand = 'Brand#4') GROUP BY 1")
def vocab_intersection(spark, d):
    p = S.table(spark, d, "part").select(F.col("p_name").alias("name"), "p_brand")
    shared = Z.intersection([p.where("p_brand = 'Brand#2'").select("name"), p.where("p_brand = 'Brand#4'").select("name")])
    return p.join(shared, "name", "left_semi").groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_done(spark, d):
    return Z.without(S.table(spark, d, "documents").select("doc_id"), S.table(spark, d, "labels").select("doc_id"))


@query("SELECT DISTINCT lang AS value FROM documents UNION SELECT DISTINCT role FROM conversations")
def distinct_values(spark, d):
    return S.table(spark, d, "documents").select(F.col("lang").alias("value")).union(S.table(spark, d, "conversations").select("role")).distinct()


@query("SELECT source, string_agg(DISTINCT lang, '|' ORDER BY lang) AS langs FROM documents GROUP BY source")
def multi_value_merge(spark, d):
    return Z.multi_map(S.table(spark, d, "documents"), "source", "lang").withColumn("langs", F.array_join("values", "|")).select("source", "langs")
