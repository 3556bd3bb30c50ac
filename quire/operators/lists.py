"""Lists of texts and what hangs on them: records made, changed and removed, match edges written one by one, star graphs,
paths of files, samples, vocabularies of words to leave out or correct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = "rdf:type"
#: Keys of annotations that every text can have; others are custom. Fixed values.
FIXED_KEYS = ("genre", "genre_raw", "is_translated", "exclude", "notes")


def saved(texts: DataFrame, new: DataFrame, key: str = "_id") -> DataFrame:
    """Texts with new rows (one a key, columns of texts): a text that is there takes the values that aren't null, one that
    isn't is made."""
    n = new.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in texts.columns if c != key])
    return texts.join(n, key, "full").select(*[F.col(c) if c == key else F.coalesce(f"_new_{c}", c).alias(c) for c in texts.columns])


def removed(texts: DataFrame, edges: DataFrame, gone: DataFrame, key: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Texts without some (one column, key) and edges (src, dst) without those that touch them."""
    ids = gone.select(F.col(key)).distinct()
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed(key, end), end, "left_anti")
    return texts.join(ids, key, "left_anti"), edges


def edges_added(edges: DataFrame, pairs: DataFrame, rel: str = MATCHES, yn: str = "", both: bool = True) -> DataFrame:
    """edges: src, dst, rel, yn. Pairs (src, dst) written as edges, the other way round too; an edge of the same ends and
    relation is replaced. An end without an id, or one that is the other, makes no edge."""
    new = pairs.select("src", "dst")
    if both:
        new = new.union(pairs.select("dst", "src"))
    new = new.where("src <> dst").distinct().select("src", "dst", F.lit(rel).alias("rel"), F.lit(yn).alias("yn"))
    return edges.select(*new.columns).join(new, ["src", "dst", "rel"], "left_anti").select(*new.columns).unionByName(new)


def star(edges: DataFrame, ids: DataFrame, rel: str | None = MATCHES) -> DataFrame:
    """The edges of a relation that leave some texts (one column, _id): the graphs around each, composed."""
    own = edges if rel is None else edges.where(F.col("rel") == rel)
    return own.join(ids.select(F.col("_id").alias("src")).distinct(), "src", "left_semi").select("src", "dst", "rel").distinct()


def with_sources(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """_id: texts and what their edges (src, dst) lead to, each once."""
    ids = texts.select("_id")
    return ids.union(edges.join(ids.withColumnRenamed("_id", "src"), "src", "left_semi").select("dst")).distinct()


def file_paths(texts: DataFrame, listing: DataFrame, extensions: list[str], folder: str = "") -> DataFrame:
    """texts (id, ...) with the path, relative to a folder, of the file named after each: the first extension that there is
    one of, or null. listing: path."""
    relative = F.expr(f"substring(path, {len(folder) + 1})") if folder else F.col("path")
    names = listing.where(F.col("path").startswith(folder)).select(relative.alias("path"))
    found = None
    for k, e in enumerate(extensions):
        some = names.where(F.col("path").endswith(e)).select(F.expr(f"substring(path, 1, length(path) - {len(e)})").alias("id"), F.lit(k).alias("_k"), "path")
        found = some if found is None else found.unionByName(some)
    best = found.groupBy("id").agg(F.min_by("path", "_k").alias("path"))
    return texts.join(best, "id", "left")


def iterated(texts: DataFrame, key: str = "_id", seed: int | None = None, limit: int | None = None) -> DataFrame:
    """Texts, shuffled by a seed and cut if asked: the rows of the smallest MD5 of seed and key. A cut with a seed is a
    top-k, not a sort of the table."""
    if seed is not None:
        texts = texts.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key)
    return texts if limit is None else texts.limit(limit)


def annotations_loaded(raw: Column) -> Column:
    """The annotations of a JSON value, each a map: a list of them as it stands; the older object of objects by _id as a
    list, with source human where none is named."""
    one = "map<string,string>"
    old = F.transform(F.map_entries(F.from_json(raw, f"map<string,{one}>")), lambda e: F.map_concat(
        F.map_from_arrays(F.array(F.lit("_id"), F.lit("genre_source")), F.array(e["key"], F.coalesce(e["value"]["genre_source"], F.lit("human")))),
        F.map_filter(e["value"], lambda k, v: ~k.isin("_id", "genre_source"))))
    return F.when(F.ltrim(raw).startswith("["), F.from_json(raw, f"array<{one}>")).otherwise(old)


def annotation_keys(annotations: DataFrame, column: str = "col", fixed: tuple[str, ...] = FIXED_KEYS) -> DataFrame:
    """key, custom: the keys in use that aren't fixed, and the fixed ones."""
    custom = annotations.select(F.col(column).alias("key")).where(F.col("key").isNotNull() & ~F.col("key").isin(*fixed)).distinct().withColumn("custom", F.lit(True))
    known = annotations.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in sorted(fixed)])).alias("key"), F.lit(False).alias("custom"))
    return custom.union(known)


def fields_of(field_words: DataFrame) -> DataFrame:
    """word, fields: the inverse of fields and their words (field, word); a word is in few fields."""
    return field_words.select("field", "word").distinct().groupBy("word").agg(F.sort_array(F.collect_list("field")).alias("fields"))


def stopwords(listed: DataFrame, counts: DataFrame | None = None, include_rank: int = 0) -> DataFrame:
    """word: a list's words and, if asked, the most frequent of a vocabulary (word, count; ties by word)."""
    out = listed.select("word").where("word <> ''")
    if counts is not None and include_rank:
        out = out.union(counts.orderBy(F.col("count").desc(), "word").limit(include_rank).select("word"))
    return out.distinct()


def corrected(index: DataFrame, corrections: DataFrame) -> DataFrame:
    """A word index whose misread words (old) count as their corrections (new), summed with the words that are there. Of
    several corrections of a word the smallest holds."""
    one = corrections.groupBy(F.col("old").alias("word")).agg(F.min("new").alias("_new"))
    rest = [c for c in index.columns if c not in ("word", "count")]
    return index.join(one, "word", "left").groupBy(*rest, F.coalesce("_new", "word").alias("word")).agg(F.sum("count").alias("count"))


def tagged(index: DataFrame, pos: DataFrame) -> DataFrame:
    """A word index with each word's part of speech (word, pos), or ''."""
    one = pos.groupBy("word").agg(F.min("pos").alias("pos"))
    return index.join(one, "word", "left").withColumn("pos", F.coalesce("pos", F.lit("")))


def entities(tokens: DataFrame, only_proper: bool = True) -> DataFrame:
    """tokens: doc, i, text, pos, character (null: none). Each character's tokens of a document in number, its commonest
    form (ties: the smallest), where it is first."""
    own = tokens.where(F.col("character").isNotNull())
    if only_proper:
        own = own.where(F.col("pos") == "PROPN")
    forms = own.groupBy("doc", "character", "text").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    return forms.groupBy("doc", "character").agg(F.min_by("text", F.struct(-F.col("n"), "text")).alias("name"), F.sum("n").alias("n"), F.min("first").alias("first"))


def name_counts(texts: DataFrame, names: Column) -> DataFrame:
    """name, n: how often each is found in paragraphs; names gives an array of them for the column `paragraph`."""
    paragraphs = texts.select(F.explode(F.split("text", "\n\n")).alias("paragraph"))
    return paragraphs.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def roles(words: Column, recipient: tuple[str, ...] = ("to",), sender: tuple[str, ...] = ("from",)) -> Column:
    """recip, sender of a letter's words, from runs of capitalised words: the run after a word of the first kind is the
    recipient and the run before that one the sender, as is a run after a word of the second kind. Arrays, in order."""
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    run = r"(?:\p{Lu}[\p{L}'.]*)(?: \p{Lu}[\p{L}'.]*)*"
    starts = lambda kinds: "(?i:" + "|".join(kinds) + ")"
    after = lambda kinds: F.regexp_extract_all(text, F.lit(rf" {starts(kinds)} ({run})(?= )"), F.lit(1))
    before = F.regexp_extract_all(text, F.lit(rf" ({run})(?=(?: (?!\p{{Lu}})[^ ]+)*? {starts(recipient)} {run} )"), F.lit(1))
    return F.struct(after(recipient).alias("recip"), F.concat(before, after(sender)).alias("sender"))


def spanned(tokens: DataFrame, spans: DataFrame, column: str = "char_id") -> DataFrame:
    """tokens (doc, i, ...) with the characters of the spans (doc, first, last, char_id) that cover each, or ''."""
    covered = spans.where("first <= last").select("doc", F.explode(F.sequence("first", "last")).alias("i"), F.col("char_id").alias("_c")).distinct()
    named = covered.groupBy("doc", "i").agg(F.array_join(F.sort_array(F.collect_list("_c")), "; ").alias(column))
    return tokens.join(named, ["doc", "i"], "left").withColumn(column, F.coalesce(column, F.lit("")))
