"""Word-frequency queries over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import words as W
from quire.sources import tables as S

from .base import TEXTS, WORDS, query

TRACKED = ["the", "die", "que", "was", "and"]
IN = ", ".join(f"'{w}'" for w in TRACKED)


def index(spark, d):
    return S.stored_index(spark, d)


@query(f"WITH {WORDS} SELECT _id, word, \"count\" FROM word_index")
def word_index(spark, d):
    return S.word_index(S.texts(spark, d).select("_id", "text")).select("_id", "word", "count")


@query(f"WITH {WORDS} SELECT _id, sum(\"count\")::BIGINT AS n_words FROM word_index GROUP BY _id")
def wordcounts(spark, d):
    return W.n_words(index(spark, d))


@query(f"WITH {WORDS} SELECT _id, CASE WHEN year < 1700 THEN -1 ELSE sum(\"count\") END::BIGINT AS n_words FROM word_index GROUP BY _id, year")
def wordcounts_incremental(spark, d):
    i = index(spark, d)
    done = i.where("year < 1700").select("_id").distinct().withColumn("n_words", F.lit(-1).cast("long"))
    return W.n_words_added(i, done)


@query(f"WITH {WORDS} SELECT word, sum(\"count\")::BIGINT AS n FROM word_index GROUP BY word ORDER BY n DESC, word LIMIT 200")
def mfw(spark, d):
    return W.most_frequent(index(spark, d), 200)


@query(f"WITH {WORDS} SELECT word, count(*)::BIGINT AS n FROM word_index GROUP BY word ORDER BY n DESC, word LIMIT 200")
def mfw_by_texts(spark, d):
    return W.most_frequent(index(spark, d), 200, by_texts=True)


@query(f"""WITH {WORDS}, c AS (SELECT genre, word, sum("count")::BIGINT AS n FROM word_index GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY n DESC, word)::INTEGER AS place, sum(n) OVER (PARTITION BY genre) AS total FROM c)
SELECT genre, word, n, round(n * 1000000.0::DOUBLE / total, 6) AS fpm, place FROM r WHERE place <= 50""")
def mfw_group_fpm(spark, d):
    return W.most_frequent_by(index(spark, d), "genre", 50)


@query(f"WITH {WORDS} SELECT word, count(*)::BIGINT AS df FROM word_index GROUP BY word ORDER BY df DESC, word LIMIT 500")
def vocab_doc_freq(spark, d):
    return W.vocabulary(index(spark, d), 500)


CUBE = """vocab AS (SELECT word FROM word_index GROUP BY word ORDER BY count(*) DESC, word LIMIT 500)"""


@query(f"""WITH {WORDS}, {CUBE} SELECT word, year, corpus, genre, sum("count")::BIGINT AS word_count, count(*)::BIGINT AS n_texts,
coalesce(sum("count") FILTER (id::BIGINT % 2 = 0), 0)::BIGINT AS word_count_dedup, count(*) FILTER (id::BIGINT % 2 = 0)::BIGINT AS n_texts_dedup
FROM word_index WHERE word IN (SELECT word FROM vocab) GROUP BY ALL""")
def word_year_cube(spark, d):
    i = index(spark, d)
    return W.cube(i, W.vocabulary(i, 500), F.col("id").cast("long") % 2 == 0)


@query(f"""WITH {WORDS}, {CUBE}, t AS (SELECT _id, year, corpus, genre, sum("count") AS n FROM word_index GROUP BY ALL)
SELECT year, corpus, genre, count(*)::BIGINT AS n_texts, sum(n)::BIGINT AS total_words FROM t
WHERE _id IN (SELECT _id FROM word_index WHERE word IN (SELECT word FROM vocab)) GROUP BY ALL""")
def totals_cube(spark, d):
    i = index(spark, d)
    return W.totals(i, W.vocabulary(i, 500))


def _series_sql(n: int, by: str = "", where: str = "", extra: str = "") -> str:
    keys = f"period{', ' + by if by else ''}"
    return f"""WITH {WORDS}{extra}, p AS (SELECT *, (year // {n} * {n})::INTEGER AS period FROM word_index {where}),
t AS (SELECT {keys}, sum("count") AS total FROM p GROUP BY ALL),
c AS (SELECT {keys}, word, sum("count")::BIGINT AS raw_count, count(*)::BIGINT AS n_texts FROM p WHERE word IN ({IN}) GROUP BY ALL)
SELECT {keys}, word, round(raw_count * 1000000.0::DOUBLE / total, 6) AS value, raw_count, n_texts FROM c JOIN t USING ({keys})"""


@query(_series_sql(10))
def ngram_decade(spark, d):
    return W.series(index(spark, d), TRACKED)


@query(f"WITH {WORDS} SELECT (year // 10 * 10)::INTEGER AS period, word, sum(\"count\")::DOUBLE AS value, sum(\"count\")::BIGINT AS raw_count, count(*)::BIGINT AS n_texts FROM word_index WHERE word IN ({IN}) GROUP BY ALL")
def ngram_raw(spark, d):
    return W.series(index(spark, d), TRACKED, per_million=False)


@query(_series_sql(50, "corpus"))
def ngram_by_corpus(spark, d):
    return W.series(index(spark, d), TRACKED, 50, by=("corpus",))


@query(_series_sql(10, where="WHERE _id IN (SELECT _id FROM kept)", extra=""",
kept AS (SELECT _id FROM (SELECT _id, row_number() OVER (PARTITION BY title, author ORDER BY year, _id) AS n FROM texts) WHERE n = 1)"""))
def ngram_dedup(spark, d):
    t = S.texts(spark, d).withColumn("grp", F.concat_ws("\u0001", "title", "author"))
    kept = W.kept_by(t, "grp", [F.col("year").asc_nulls_last(), F.col("_id")])
    return W.series(index(spark, d).join(kept.select("_id"), "_id", "left_semi"), TRACKED)


@query(f"""WITH s AS ({_series_sql(10)})
SELECT period, round(coalesce(sum(CASE word WHEN 'the' THEN value WHEN 'and' THEN value WHEN 'was' THEN -value ELSE 0 END), 0), 6) AS "the+and-was",
  round(coalesce(sum(CASE word WHEN 'die' THEN value ELSE 0 END), 0), 6) AS "die" FROM s WHERE word IN ('the', 'and', 'was', 'die') GROUP BY period""")
def ngram_expression(spark, d):
    return W.expression_series(index(spark, d), "the+and-was, die")


@query(f"""WITH {WORDS}, o AS (SELECT _id, sum("count") FILTER (word = 'the')::BIGINT AS "count", sum("count")::BIGINT AS n_words FROM word_index GROUP BY _id)
SELECT *, round("count" * 1000000.0::DOUBLE / n_words, 6) AS per_million FROM o WHERE "count" IS NOT NULL ORDER BY per_million DESC, _id LIMIT 25""")
def ngram_examples(spark, d):
    return W.examples(index(spark, d), "the", 25)


@query(f"""WITH {WORDS} SELECT word, count(*)::BIGINT AS n_texts, sum("count")::BIGINT AS n FROM word_index
WHERE word <> 'was' AND _id IN (SELECT _id FROM word_index WHERE word = 'was') GROUP BY word ORDER BY n_texts DESC, n DESC, word LIMIT 50""")
def ngram_collocates(spark, d):
    return W.collocates(index(spark, d), "was", 50)


M = 'm AS (SELECT word FROM word_index GROUP BY word ORDER BY sum("count") DESC, word LIMIT 100), long AS (SELECT _id, word, "count" AS n, "count" / sum("count") OVER (PARTITION BY _id) AS tf FROM word_index WHERE word IN (SELECT word FROM m))'


def long(spark, d):
    i = index(spark, d)
    return W.matrix(i, W.most_frequent(i, 100))


@query(f"WITH {WORDS}, {M} SELECT _id, word, n, round(tf, 6) AS tf FROM long")
def dtm_long(spark, d):
    return long(spark, d).withColumn("tf", F.round("tf", 6))


@query(f"WITH {WORDS}, {M} SELECT _id, " + ", ".join(f"coalesce(max(n) FILTER (word = '{w}'), 0)::BIGINT AS \"{w}\"" for w in TRACKED) + " FROM long GROUP BY _id")
def dtm_wide(spark, d):
    return W.wide(long(spark, d), TRACKED)


@query(f"WITH {WORDS} SELECT _id, word, round(\"count\" / sum(\"count\") OVER (PARTITION BY _id), 6) AS tf FROM word_index")
def tf(spark, d):
    from pyspark.sql import Window

    return index(spark, d).select("_id", "word", F.round(F.col("count") / F.sum("count").over(Window.partitionBy("_id")), 6).alias("tf"))


N = "(SELECT count(*) FROM texts)"


@query(f"""WITH {WORDS}, {M}, d AS (SELECT word, count(*) AS df FROM long GROUP BY word), w AS (SELECT _id, word, n * (ln((1.0 + {N}) / (1 + df)) + 1) AS w FROM long JOIN d USING (word))
SELECT _id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY _id)), 6) AS weight FROM w""")
def tfidf_smooth_l2(spark, d):
    n = S.table(spark, d, "documents").count()
    return W.tfidf_smooth(long(spark, d), F.lit(n)).select("_id", "word", F.round("weight", 6).alias("weight"))


@query(f"WITH {WORDS}, {M}, d AS (SELECT word, count(*) AS df FROM long GROUP BY word) SELECT _id, word, round(tf * log10({N} / df), 6) AS weight FROM long JOIN d USING (word)")
def tfidf_log10(spark, d):
    n = S.table(spark, d, "documents").count()
    return W.tfidf_log10(long(spark, d), F.lit(n)).select("_id", "word", F.round("weight", 6).alias("weight"))


@query(f"""WITH {WORDS}, {M}, f AS (SELECT m.word, texts.genre, coalesce(long.tf, 0) AS tf FROM m CROSS JOIN texts LEFT JOIN long ON long._id = texts._id AND long.word = m.word)
SELECT genre AS "group", word, round(median(tf), 6) AS median FROM f GROUP BY ALL""")
def mdw_median(spark, d):
    groups = S.texts(spark, d).select("_id", F.col("genre").alias("group"))
    i = index(spark, d)
    words = W.most_frequent(i, 100)
    return W.group_medians(W.matrix(i, words), groups, words).withColumn("median", F.round("median", 6))


@query(f"""WITH {WORDS}, {M}, g AS (SELECT _id, genre FROM texts), ws AS (SELECT DISTINCT word FROM long), f AS (SELECT ws.word, g._id, g.genre, coalesce(long.tf, 0) AS tf FROM ws CROSS JOIN g LEFT JOIN long ON long._id = g._id AND long.word = ws.word),
gp AS (SELECT a.genre AS g1, b.genre AS g2 FROM (SELECT DISTINCT genre FROM g) a JOIN (SELECT DISTINCT genre FROM g) b ON a.genre < b.genre),
pr AS (SELECT f.word, g1, g2, genre, tf FROM f JOIN gp ON genre = g1 OR genre = g2),
r AS (SELECT *, rank() OVER (PARTITION BY word, g1, g2 ORDER BY tf) + (count(*) OVER (PARTITION BY word, g1, g2, tf) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY word, g1, g2, tf)::DOUBLE AS t FROM pr),
s AS (SELECT word, g1 AS group1, g2 AS group2, sum(r) FILTER (genre = g1)::DOUBLE AS ranks, (count(*) FILTER (genre = g1))::DOUBLE AS na, (count(*) FILTER (genre = g2))::DOUBLE AS nb, sum(t * t - 1) AS ties,
  avg(tf) FILTER (genre = g1) AS m1, avg(tf) FILTER (genre = g2) AS m2 FROM r GROUP BY ALL)
SELECT word, group1, group2, round(ranks - na * (na + 1) / 2, 4) AS u, round((ranks - na * (na + 1) / 2 - na * nb / 2) / sqrt(na * nb / 12 * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1)))), 6) AS z, round(m1, 6) AS group1_mean, round(m2, 6) AS group2_mean FROM s""")
def mann_whitney_u(spark, d):
    groups = S.texts(spark, d).select("_id", F.col("genre").alias("group"))
    out = W.mann_whitney(long(spark, d), groups)
    return out.select("word", "group1", "group2", F.round("u", 4).alias("u"), *[F.round(c, 6).alias(c) for c in ("z", "group1_mean", "group2_mean")])


FIELDS = [("being", "was"), ("being", "are"), ("article", "the"), ("article", "die"), ("article", "la"), ("link", "and"), ("link", "que")]


@query(f"""WITH {WORDS}, f AS (SELECT * FROM (VALUES {', '.join(str(x) for x in FIELDS)}) AS v(field, word)) SELECT _id, field, sum("count")::BIGINT AS n FROM word_index JOIN f USING (word) GROUP BY ALL""")
def field_counts(spark, d):
    return W.fields(index(spark, d), spark.createDataFrame(FIELDS, "field string, word string"))


@query(f"""WITH {WORDS}, v AS (SELECT word FROM word_index GROUP BY word ORDER BY count(*) DESC, word LIMIT 500)
SELECT _id, round(sum(CASE WHEN word IN (SELECT word FROM v) THEN "count" ELSE 0 END) / sum("count"), 6) AS share FROM word_index GROUP BY _id""")
def ocr_accuracy(spark, d):
    i = index(spark, d)
    return W.known_share(i, W.vocabulary(i, 500)).withColumn("share", F.round("share", 6))


@query(f"WITH {TEXTS}, k AS (SELECT *, row_number() OVER (PARTITION BY title, author ORDER BY corpus, _id) AS n FROM texts WHERE year >= 1700) SELECT _id, corpus, year FROM k WHERE n = 1")
def dedup_rank(spark, d):
    t = S.texts(spark, d).where("year >= 1700").withColumn("grp", F.concat_ws("\u0001", "title", "author"))
    return W.kept_by(t, "grp", [F.col("corpus"), F.col("_id")]).select("_id", "corpus", "year")


@query(f"WITH {TEXTS}, k AS (SELECT *, row_number() OVER (PARTITION BY title, author ORDER BY year NULLS LAST, corpus, _id) AS n FROM texts WHERE genre <> 'Essay') SELECT _id, corpus, year FROM k WHERE n = 1")
def dedup_oldest(spark, d):
    t = S.texts(spark, d).where("genre <> 'Essay'").withColumn("grp", F.concat_ws("\u0001", "title", "author"))
    return W.kept_by(t, "grp", [F.col("year").asc_nulls_last(), F.col("corpus"), F.col("_id")]).select("_id", "corpus", "year")
