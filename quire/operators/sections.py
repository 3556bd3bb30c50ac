"""Texts cut into paragraphs, passages, slices, n-grams, keyword contexts and structural sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def paragraphs(texts: DataFrame, text: str = "text") -> DataFrame:
    """_id, section_id P0001 and so on, place, words, and the paragraph itself."""
    rows = texts.select("_id", F.posexplode(T.paragraphs(text)).alias("p", "paragraph"))
    return rows.select("_id", F.format_string("P%04d", F.col("p") + 1).alias("section_id"), (F.col("p") + 1).alias("place"), F.size(T.whitespace_words("paragraph")).alias("n_words"), "paragraph")


def packed_sentences(sentences: Column, n: int) -> Column:
    """Arrays of (start, end, text): whole sentences until at least n words; the rest last, however short. Positions count
    words. One fold over a text's sentences."""
    words = lambda s: F.size(T.whitespace_words(s))
    kind = "struct<done:array<struct<start:int,end:int,text:string>>,at:int,n:int,held:array<string>>"
    start = F.from_json(F.lit('{"done":[],"at":0,"n":0,"held":[]}'), kind)

    def step(a: Column, s: Column) -> Column:
        more = a["n"] + words(s)
        held = F.concat(a["held"], F.array(s))
        full = F.struct(
            F.concat(a["done"], F.array(F.struct(a["at"].alias("start"), (a["at"] + more).alias("end"), F.array_join(held, " ").alias("text")))).alias("done"),
            (a["at"] + more).alias("at"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("held"),
        )
        return F.when(more >= n, full).otherwise(F.struct(a["done"].alias("done"), a["at"].alias("at"), more.alias("n"), held.alias("held")))

    def rest(a: Column) -> Column:
        last = F.array(F.struct(a["at"].alias("start"), (a["at"] + a["n"]).alias("end"), F.array_join(a["held"], " ").alias("text")))
        return F.when(a["n"] > 0, F.concat(a["done"], last)).otherwise(a["done"])

    return F.aggregate(sentences, start, step, rest)


def passages(texts: DataFrame, n: int, text: str = "text") -> DataFrame:
    """_id, section_id W{start}_{end}, start, end, passage."""
    rows = texts.select("_id", F.inline(packed_sentences(T.sentences(text), n)))
    return rows.select("_id", F.format_string("W%d_%d", "start", "end").alias("section_id"), "start", "end", F.col("text").alias("passage"))


def slices(texts: DataFrame, n: int, text: str = "text") -> DataFrame:
    return texts.select("_id", F.posexplode(T.fixed_slices(T.tokens(text), n)).alias("place", "words")).select("_id", "place", F.array_join("words", " ").alias("slice"))


def ngram_counts(texts: DataFrame, n: int, text: str = "text") -> DataFrame:
    return texts.select(F.explode(T.ngrams(T.tokens(text), n)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


def keyword_in_context(texts: DataFrame, word: str, window: int, text: str = "text") -> DataFrame:
    """Each hit of a word with the words around it: positions are found and the contexts sliced inside the row."""
    rows = texts.select("_id", T.tokens(text).alias("t"))
    hits = rows.select("_id", "t", F.explode(F.filter(F.transform("t", lambda x, i: F.when(x == word, i)), lambda i: i.isNotNull())).alias("pos"))
    half = window // 2
    start = F.greatest(F.col("pos") - half, F.lit(0))
    left, right = F.slice("t", start + 1, F.col("pos") - start), F.slice("t", F.col("pos") + 2, half)
    return hits.select("_id", "pos", F.array_join(left, " ").alias("left"), F.array_join(right, " ").alias("right"))


def word_window(text: Column | str, n: int, last: bool = False) -> Column:
    return T.let(T.whitespace_words(text), lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)) if last else F.lit(1), n), " "))


def offsets(sections: DataFrame, key: str, order: list[str], text: str = "text", gap: int = 5) -> DataFrame:
    """Where each section starts and ends once all of a key's are joined by `gap` line feeds."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0))
    return sections.withColumn("start", start).withColumn("end", start + F.length(text))


def concatenated(sections: DataFrame, key: str, order: str, text: str = "text", gap: int = 5) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return sections.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), "\n" * gap).alias(text))


def largest_tag(df: DataFrame, column: str, tags: list[str]) -> DataFrame:
    """The tag that opens most often in a document, the later of equal ones; null if none does."""
    counts = [F.struct(F.regexp_count(column, F.lit(rf"<{t}\b")).alias("n"), F.lit(k).alias("k"), F.lit(t).alias("tag")) for k, t in enumerate(tags)]
    best = F.array_max(F.array(*counts))
    return df.withColumn("tag", F.when(best["n"] > 0, best["tag"]))


def tagged_sections(df: DataFrame, key: str, column: str, tag: str) -> DataFrame:
    """key, section_id S0001 and so on, title (the first heading's text) and text of each element of a tag."""
    found = F.regexp_extract_all(column, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), 1)
    rows = df.select(key, F.posexplode(found).alias("p", "inner"))
    title = T.unhtml(F.regexp_extract("inner", r"(?s)<(head|h[1-6]|title)\b[^>]*>(.*?)</\1>", 2))
    return rows.select(key, F.format_string("S%04d", F.col("p") + 1).alias("section_id"), title.alias("title"), T.unhtml("inner").alias("text"))
