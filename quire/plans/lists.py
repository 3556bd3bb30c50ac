"""Queries over lists of texts: records saved and removed, match edges, paths, samples, vocabularies, marked-up texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import markup as U
from quire.operators import lists as L
from quire.sources import readers as R
from quire.sources import scratch
from quire.sources import sinks as K
from quire.sources import tables as S

from .base import PARTS, WORDS, query


def _pairs(spark, d):
    return S.table(spark, d, "part").select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"))


@query(f"WITH {PARTS} SELECT _id, corpus, id, title, CASE WHEN year % 2 = 0 THEN 'new' ELSE author END AS author, year FROM parts UNION ALL SELECT '_new/' || n_nationkey, NULL, NULL, n_name, 'new', NULL FROM nation")
def saved_texts(spark, d):
    p = S.parts(spark, d)
    some = p.where("year % 2 = 0").select("_id", F.lit(None).cast("string").alias("title"))
    made = S.table(spark, d, "nation").select(F.concat(F.lit("_new/"), F.col("n_nationkey").cast("string")).alias("_id"), F.col("n_name").alias("title"))
    null = lambda t: F.lit(None).cast(t)
    return L.saved(p, some.union(made).select("_id", null("string").alias("corpus"), null("string").alias("id"), "title", F.lit("new").alias("author"), null("int").alias("year")))


@query(f"WITH {PARTS} SELECT _id, title FROM parts WHERE year % 3 <> 0")
def removed_texts(spark, d):
    p = S.parts(spark, d)
    return L.removed(p, _pairs(spark, d), p.where("year % 3 = 0").select("_id"))[0].select("_id", "title")


@query("SELECT p_brand AS src, p_type AS dst FROM part WHERE p_type <> 'PROMO'")
def removed_edges(spark, d):
    gone = spark.createDataFrame([("PROMO",)], "_id string")
    return L.removed(S.parts(spark, d), _pairs(spark, d), gone)[1]


ADDED = """old AS (SELECT DISTINCT p_brand AS src, p_type AS dst, 'rdf:type' AS rel, 'n' AS yn FROM part WHERE p_size < 25),
pairs AS (SELECT p_brand AS src, p_type AS dst FROM part WHERE p_size > 20), new AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs),
edges AS (SELECT src, dst, rel, yn FROM old WHERE (src, dst) NOT IN (SELECT (src, dst) FROM new) UNION ALL SELECT src, dst, 'rdf:type', 'y' FROM new)"""


def _added(spark, d):
    p = S.table(spark, d, "part")
    of = lambda where: p.where(where).select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"))
    old = of("p_size < 25").distinct().select("src", "dst", F.lit(L.MATCHES).alias("rel"), F.lit("n").alias("yn"))
    return L.edges_added(old, of("p_size > 20"), yn="y")


@query(f"WITH {ADDED} SELECT * FROM edges")
def edges_added(spark, d):
    return _added(spark, d)


@query(f"WITH {ADDED} SELECT src, dst, rel FROM edges WHERE src IN (SELECT p_type FROM part WHERE p_size = 30)")
def match_star(spark, d):
    return L.star(_added(spark, d), S.table(spark, d, "part").where("p_size = 30").select(F.col("p_type").alias("_id")))


@query(f"WITH {ADDED}, t AS (SELECT DISTINCT p_brand AS _id FROM part WHERE p_size = 30) SELECT _id FROM t UNION SELECT dst FROM edges WHERE src IN (SELECT _id FROM t)")
def texts_with_sources(spark, d):
    return L.with_sources(S.table(spark, d, "part").where("p_size = 30").select(F.col("p_brand").alias("_id")).distinct(), _added(spark, d))


@query("SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size % 3 = 0 THEN p_partkey || '.json' WHEN p_size % 3 = 1 THEN p_partkey || '.json.gz' END AS path FROM part")
def file_paths(spark, d):
    p = S.table(spark, d, "part")
    names = lambda where, end: p.where(where).select(F.concat(F.lit("/corpus/freqs/"), F.col("p_partkey").cast("string"), F.lit(end)).alias("path"))
    listing = names("p_size % 3 < 2", ".json.gz").union(names("p_size % 3 = 0", ".json")).union(names("p_size % 3 = 2", ".txt"))
    return L.file_paths(p.select(F.col("p_partkey").cast("string").alias("id")), listing, [".json", ".json.gz"], "/corpus/freqs/")


@query(f"WITH {PARTS} SELECT _id, title FROM parts ORDER BY md5('7:' || _id), _id LIMIT 50")
def iterated_texts(spark, d):
    return L.iterated(S.parts(spark, d), seed=7, limit=50).select("_id", "title")


@query("SELECT p_partkey, 'a' || p_size AS _id, CASE WHEN p_size % 2 = 0 THEN 'llm' ELSE 'human' END AS source, p_name AS genre FROM part UNION ALL SELECT p_partkey, 'b', 'human', NULL FROM part WHERE p_size % 2 = 1")
def annotations_loaded(spark, d):
    name = F.concat(F.lit('"genre": "'), "p_name", F.lit('"'))
    new = F.concat(F.lit('[{"_id": "a'), "p_size", F.lit('", "genre_source": "llm", '), name, F.lit("}]"))
    old = F.concat(F.lit('{"a'), "p_size", F.lit('": {'), name, F.lit('}, "b": {"genre_source": "human"}}'))
    raw = F.when(F.col("p_size") % 2 == 0, new).otherwise(old)
    rows = S.table(spark, d, "part").select("p_partkey", F.explode(L.annotations_loaded(raw)).alias("m"))
    return rows.select("p_partkey", F.col("m")["_id"].alias("_id"), F.col("m")["genre_source"].alias("source"), F.col("m")["genre"].alias("genre"))


@query("SELECT unnest(['exclude', 'genre', 'genre_raw', 'is_translated', 'notes']) AS key, false AS custom UNION ALL SELECT DISTINCT event_type, true FROM events")
def annotation_keys(spark, d):
    e = S.table(spark, d, "events").select(F.col("event_type").alias("col"))
    return L.annotation_keys(e.union(e.select(F.lit("genre"))))


@query("SELECT p_name AS word, list_sort(list(DISTINCT p_type)) AS fields FROM part GROUP BY 1")
def words_to_fields(spark, d):
    return L.fields_of(S.table(spark, d, "part").select(F.col("p_type").alias("field"), F.col("p_name").alias("word")))


@query(f"WITH {WORDS}, top AS (SELECT word FROM word_index GROUP BY 1 ORDER BY sum(count) DESC, word LIMIT 40) SELECT word FROM top UNION SELECT n_name FROM nation")
def stopwords(spark, d):
    counts = S.stored_index(spark, d).groupBy("word").agg(F.sum("count").alias("count"))
    return L.stopwords(S.table(spark, d, "nation").select(F.col("n_name").alias("word")), counts, 40)


@query(f"WITH {WORDS} SELECT _id, CASE WHEN word LIKE 'f%' THEN 's' || word[2:] ELSE word END AS word, sum(count)::BIGINT AS count FROM word_index GROUP BY 1, 2")
def ocr_corrected(spark, d):
    index = S.stored_index(spark, d).select("_id", "word", "count")
    fixes = index.where("word like 'f%'").select(F.col("word").alias("old"), F.concat(F.lit("s"), F.expr("substring(word, 2)")).alias("new")).distinct()
    return L.corrected(index, fixes)


@query("SELECT p_partkey, p_name AS word, p_name || '-pos' AS pos FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, p_type || p_partkey, '' FROM part WHERE p_size % 2 = 1")
def parts_of_speech(spark, d):
    p = S.table(spark, d, "part")
    path = scratch.new_path(spark, "pos")
    names = p.select("p_name").distinct()
    names.select(F.to_json(F.create_map("p_name", F.concat("p_name", F.lit("-pos"))))).write.text(path)
    words = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_type", F.col("p_partkey").cast("string"))).alias("word"))
    return L.tagged(words, R.word_map(spark, path))


@query("""WITH t AS (SELECT p_brand AS doc, p_partkey AS i, p_name AS text, p_type AS c FROM part WHERE p_size % 3 = 0 AND p_size % 5 > 0), f AS (SELECT doc, c, text, count(*) AS n, min(i) AS first FROM t GROUP BY ALL)
SELECT doc, c AS character, arg_min(text, (-n, text)) AS name, sum(n)::BIGINT AS n, min(first) AS first FROM f GROUP BY doc, c""")
def character_entities(spark, d):
    pos = F.when(F.col("p_size") % 3 == 0, "PROPN").otherwise("NOUN")
    tokens = S.table(spark, d, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("i"), F.col("p_name").alias("text"), pos.alias("pos"), F.when(F.col("p_size") % 5 > 0, F.col("p_type")).alias("character"))
    return L.entities(tokens)


@query("""WITH s AS (SELECT DISTINCT p_brand AS doc, unnest(range(p_partkey, p_partkey + p_size % 4 + 1)) AS i, p_type AS c FROM part), n AS (SELECT doc, i, string_agg(c, '; ' ORDER BY c) AS char_id FROM s GROUP BY ALL)
SELECT p_brand AS doc, p_partkey AS i, p_name AS text, coalesce(char_id, '') AS char_id FROM part LEFT JOIN n ON doc = p_brand AND i = p_partkey""")
def token_table(spark, d):
    p = S.table(spark, d, "part").withColumn("i", F.col("p_partkey"))
    spans = p.select(F.col("p_brand").alias("doc"), F.col("i").alias("first"), (F.col("i") + F.col("p_size") % 4).alias("last"), F.col("p_type").alias("char_id"))
    return L.spanned(p.select(F.col("p_brand").alias("doc"), "i", F.col("p_name").alias("text")), spans)


@query(r"""WITH t AS (SELECT unnest(regexp_extract_all(text, '\b[A-Z][a-z]+\b')) AS name FROM documents) SELECT name, count(*)::BIGINT AS n FROM t GROUP BY 1""")
def name_counts(spark, d):
    return L.name_counts(S.table(spark, d, "documents").select("text"), F.regexp_extract_all("paragraph", F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?![A-Za-z0-9_])"), F.lit(0)))


@query("SELECT s_suppkey, ['Ann'] AS sender, ['Bob ' || 'X' || s_suppkey::VARCHAR.translate('0123456789', 'abcdefghij')] AS recip FROM supplier")
def letter_roles(spark, d):
    name = F.concat(F.lit("a letter Ann wrote to Bob X"), F.translate(F.col("s_suppkey").cast("string"), "0123456789", "abcdefghij"), F.lit(" in haste"))
    return S.table(spark, d, "supplier").select("s_suppkey", L.roles(F.split(name, " ")).alias("r")).select("s_suppkey", "r.*")


@query(r"""SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<head(?:\s[^>]*)?>.*?</head\s*>', '', 'g'), '(?is)<nav(?:\s[^>]*)?>.*?</nav\s*>', '', 'g') AS html FROM pages""")
def tags_removed(spark, d):
    return S.table(spark, d, "pages").select("page_id", U.without_tags("html", ["head", "nav"]).alias("html"))


@query("SELECT p_partkey, p_name AS title, p_brand AS author, p_type AS publisher, (1600 + p_size)::INTEGER AS year, 'S' || p_partkey AS estc FROM part")
def text_headers(spark, d):
    w = lambda *x: F.concat(*[F.lit(v) if "<" in v else F.col(v).cast("string") for v in x])
    raw = S.table(spark, d, "part").withColumn("y", F.lit(1600) + F.col("p_size")).select("p_partkey", w('<IDNO TYPE="file">A1</IDNO><IDNO TYPE="estc no">S', "p_partkey", '</IDNO><IDNO TYPE="x">[', "p_size", '</IDNO><BIBLFULL><TITLE TYPE="245">', "p_name", "</TITLE><AUTHOR>", "p_brand", "</AUTHOR><PUBLISHER>", "p_type", "</PUBLISHER><DATE>[", "y", "]</DATE></BIBLFULL>").alias("raw"))
    h = raw.select("p_partkey", U.header("raw").alias("h"))
    return h.select("p_partkey", "h.title", "h.author", "h.publisher", "h.year", F.map_from_entries("h.ids")["id_estc_no"].alias("estc"))


@query("SELECT p_partkey, p_name || ' said' || chr(10) || chr(10) || p_type AS text FROM part")
def speeches(spark, d):
    raw = F.concat(F.lit("<p>no</p><u who='a'>\n "), "p_name", F.lit("\r\n  said</u> no <u><b>"), "p_type", F.lit("</b></u>"))
    return S.table(spark, d, "part").select("p_partkey", U.speeches(raw).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_brand ELSE '' END AS author FROM part")
def author_fallback(spark, d):
    m = F.col("p_size") % 3
    return S.table(spark, d, "part").select("p_partkey", U.first_of(F.when(m == 0, F.concat(F.lit(" "), "p_name")), F.when(m == 1, F.col("p_brand")).otherwise("\n"), F.lit(" ")).alias("author"))


@query("SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: x || '_' || p_type) AS words FROM part")
def labelled_words(spark, d):
    return S.table(spark, d, "part").select("p_partkey", U.labelled(F.split("p_name", " "), F.col("p_type")).alias("words"))


@query("SELECT 'S' || p_partkey AS estc_id, '00' || p_size AS leader, p_brand AS institution_code, p_name AS shelfmark, NULL::VARCHAR AS note FROM part UNION ALL SELECT 'S' || p_partkey, '00' || p_size, 'X', NULL, p_type FROM part")
def marc_holdings(spark, d):
    path = scratch.new_path(spark, "holdings")
    sub = lambda **kv: F.array(*[F.create_map(F.lit(k), v) for k, v in kv.items()])
    field = lambda s: F.create_map(F.lit("852"), F.struct(F.lit(" ").alias("ind1"), s.alias("subfields")))
    one = F.to_json(field(sub(a=F.col("p_brand"), j=F.col("p_name"))))
    two = F.to_json(field(sub(a=F.lit("X"), q=F.col("p_type"), a2=F.lit("y"))))
    line = F.concat(F.lit('{"leader": "00'), "p_size", F.lit('", "fields": [{"001": "S'), "p_partkey", F.lit('"}, '), one, F.lit(", "), two, F.lit("]}"))
    S.table(spark, d, "part").select(line).write.text(path)
    return R.marc_holdings(spark, path).select("estc_id", "leader", "institution_code", "shelfmark", "note")


@query("SELECT p_brand || ' & <' AS src, p_type AS dst, sum(p_size)::DOUBLE AS weight FROM part GROUP BY 1, 2")
def gexf_round_trip(spark, d):
    edges = S.table(spark, d, "part").groupBy(F.concat("p_brand", F.lit(" & <")).alias("src"), F.col("p_type").alias("dst")).agg(F.sum("p_size").cast("double").alias("weight"))
    path = scratch.new_path(spark, "graph") + ".gexf"
    K.write_gexf(edges, path)
    return R.gexf_edges(spark, path)


@query("SELECT doc_id::VARCHAR AS id, lang AS author, coalesce(text, '') AS text FROM documents")
def corpus_export(spark, d):
    folder = scratch.new_path(spark, "export")
    K.export(S.texts(spark, d).select("id", "author", "text"), folder)
    meta = R.metadata(spark, f"{folder}/metadata.csv").select("id", "author")
    return meta.join(R.metadata(spark, f"{folder}/texts.jsonl"), "id").select("id", "author", F.coalesce("text", F.lit("")).alias("text"))
