"""How queries and the SQL they are checked against are registered."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}

TEXTS = """texts AS (
  SELECT '_' || source || '/' || doc_id AS _id, source AS corpus, doc_id::VARCHAR AS id, split_part(text, chr(10), 1) AS title, lang AS author,
    (1600 + doc_id % 300)::INTEGER AS year, CASE lang WHEN 'en' THEN 'Fiction' WHEN 'fr' THEN 'Poetry' WHEN 'de' THEN 'Drama' ELSE 'Essay' END AS genre, text
  FROM documents)"""
TOKENS = r"list_filter(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_''\-]+'), lambda x: trim(x, '_''-')), lambda x: x <> '')"
WORDS = (
    TEXTS
    + rf""",
tokens AS (SELECT _id, corpus, id, year, genre, unnest({TOKENS}) AS word FROM texts),
word_index AS (SELECT _id, corpus, id, year, genre, word, count(*)::BIGINT AS "count" FROM tokens WHERE regexp_matches(word, '^\p{{L}}[\p{{L}}''\-]*$') GROUP BY ALL)"""
)
PARTS = """parts AS (
  SELECT '_' || p_type || '/' || p_partkey AS _id, p_type AS corpus, p_partkey::VARCHAR AS id, p_name AS title, p_brand AS author, (1900 + p_size)::INTEGER AS year FROM part)"""


def query(sql: str | None = None, name: str | None = None):
    """Registers f(spark, folder) under its name, with its SQL if it has one."""

    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return keep
