"""Word frequencies: totals, vocabularies, cubes, time series, document-term weights and distinctive words.

All take a word index: a row for each text and word (_id, corpus, year, genre, word, count)."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def n_words(index: DataFrame) -> DataFrame:
    return index.groupBy("_id").agg(F.sum("count").alias("n_words"))


def n_words_added(index: DataFrame, done: DataFrame) -> DataFrame:
    """Totals of the texts that have none yet, and the old ones."""
    return done.unionByName(n_words(index.join(done, "_id", "left_anti")))


def most_frequent(index: DataFrame, n: int, by_texts: bool = False) -> DataFrame:
    value = F.count("*") if by_texts else F.sum("count")
    return index.groupBy("word").agg(value.alias("n")).orderBy(F.col("n").desc(), "word").limit(n)


#: Words whose totals a task of word_lists() remembers at once.
REMEMBERED = 1_000_000
#: Bytes between words, as blanks: all of ASCII that no word holds.
_BLANKS = bytes(c if c > 127 or chr(c).isalnum() or chr(c) in "_'-" else 32 for c in range(256))


def _words(piece: str) -> list[str]:
    """The words of a lower-case text's piece between such bytes, as sources.tables.word_index has them."""
    found = [w.strip("_'-") for w in ([piece] if piece.isascii() else re.findall(r"[\w'\-]+", piece))]  # \w: letters, numbers and _
    return [w for w in found if w[:1].isalpha() and re.sub("['-]", "", w).isalpha()]


def word_lists(texts: DataFrame) -> DataFrame:
    """texts: _id, text. A row for each text that has words: _id, words (with blanks between them), counts (int32 in bytes); and rows of totals, to be
    summed: word, n and texts, the words of some texts, their counts and numbers of texts. A text's words are counted where it is: no row
    for each word is shuffled."""

    def counted(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def listed(values, sizes):
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)

        def summed(parts):
            return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum"), ("texts", "sum")]).rename_columns({"n_sum": "n", "texts_sum": "texts"})

        def row(totals):
            lists = [listed(totals.column(c).combine_chunks(), [totals.num_rows]) for c in ("word", "n", "texts")]
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), *lists], names=names)

        names, totals = ["_id", "words", "counts", "word", "n", "texts"], []
        for batch in batches:
            clean = pa.array([(t or b"").translate(_BLANKS).decode("utf-8", "replace") for t in batch.column("text").to_pylist()], pa.string())
            pieces = pc.ascii_split_whitespace(clean)
            coded = pieces.flatten().dictionary_encode()
            known, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(pieces.offsets.to_numpy()))
            plain = pc.match_substring_regex(known, r"^[a-z]([a-z'\-]*[a-z])?$").to_numpy(zero_copy_only=False)
            # Any other piece may hold several words, or none
            others = np.flatnonzero(~plain)
            found = [_words(p) for p in known.take(pa.array(others)).to_pylist()]
            sizes = np.ones(len(known), np.int64)
            sizes[others] = [len(f) for f in found]
            flat = pa.array([w for f in found for w in f], pa.string())
            both = pa.concat_arrays([known, flat]).dictionary_encode()
            first = np.arange(len(known))
            first[others] = len(known) + np.cumsum(sizes[others]) - sizes[others]
            times = sizes[code]
            at = np.repeat(first[code], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            both, place = both.dictionary, both.indices.to_numpy()[at]
            key, count = np.unique(np.repeat(owner, times) * max(1, len(both)) + place, return_counts=True)
            owner, place = np.divmod(key, max(1, len(both)))
            used = np.unique(place)
            totals.append(pa.table({"word": both.take(pa.array(used)), "n": np.bincount(place, count)[used].astype(np.int64), "texts": np.bincount(place)[used].astype(np.int64)}))
            if sum(t.num_rows for t in totals) > REMEMBERED:
                totals = [summed(totals)]
                if totals[0].num_rows > REMEMBERED // 2:
                    yield row(totals.pop())
            some, sizes = np.unique(owner, return_counts=True)
            ends, counts = np.cumsum(sizes) * 4, count.astype(np.int32).tobytes()
            own = [counts[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            texts = [batch.column("_id").take(pa.array(some, pa.int64())), pc.binary_join(listed(both.take(pa.array(place)), sizes), " "), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays([*texts, *(pa.nulls(len(some), pa.list_(c)) for c in (pa.string(), pa.int64(), pa.int64()))], names=names)
        if totals:
            yield row(summed(totals))

    lower = texts.select("_id", F.lower("text").cast("binary").alias("text"))
    return lower.mapInArrow(counted, "_id string, words string, counts binary, word array<string>, n array<long>, texts array<long>")


def frequent_in(lists: DataFrame, n: int) -> DataFrame:
    """The n most frequent words of word_lists(): word, n, df; ties by word."""
    sums = lists.where("word is not null").select(F.explode(F.arrays_zip("word", "n", "texts")).alias("p"))
    return sums.groupBy(F.col("p.word").alias("word")).agg(F.sum("p.n").alias("n"), F.sum("p.texts").alias("df")).orderBy(F.col("n").desc(), "word").limit(n)


def packed_counts(lists: DataFrame, words: list[str]) -> DataFrame:
    """word_lists() over these words only: _id, i (places in the list, ascending), w (counts), both int32 in bytes, and name, equal for equal rows.
    Texts without any of them, or without an _id, are left out."""

    def packed(batches):
        import hashlib

        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(words, pa.string())
        for batch in batches:
            column = pc.ascii_split_whitespace(batch.column("words"))
            place = pc.fill_null(pc.index_in(column.flatten(), value_set=known), -1).to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            count, kept = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.int32), place >= 0
            owner, place, count = owner[kept], place[kept], count[kept]
            order = np.lexsort((place, owner))
            place, count = place[order].astype(np.int32).tobytes(), count[order].tobytes()
            ends = np.cumsum(np.bincount(owner, minlength=batch.num_rows)) * 4
            rows = [(i, place[a:b], count[a:b]) for i, a, b in zip(batch.column("_id").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True) if b > a]
            ids, i, w = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
            names = [hashlib.md5(p + q).digest() for p, q in zip(i, w, strict=True)]  # of equal lengths
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *(pa.array(c, pa.binary()) for c in (i, w, names))], names=["_id", "i", "w", "name"])

    texts = lists.where("words is not null and _id is not null").select("_id", "words", "counts")
    return texts.mapInArrow(packed, "_id string, i binary, w binary, name binary")


def vocabulary(index: DataFrame, n: int, min_count: int = 1) -> DataFrame:
    """The n words of most texts."""
    return index.where(F.col("count") >= min_count).groupBy("word").agg(F.count("*").alias("df")).orderBy(F.col("df").desc(), "word").limit(n)


def most_frequent_by(index: DataFrame, group: str, n: int) -> DataFrame:
    """The n most frequent words of each group, with their frequency per million and place."""
    counts = index.groupBy(group, "word").agg(F.sum("count").alias("n"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("_total"))
    first = Window.partitionBy(group).orderBy(F.col("n").desc(), "word")
    ranked = counts.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n)
    return ranked.join(F.broadcast(totals), group).select(group, "word", "n", F.round(F.col("n") * 1e6 / F.col("_total"), 6).alias("fpm"), "place")


def cube(index: DataFrame, vocabulary: DataFrame | None = None, kept: Column | None = None) -> DataFrame:
    """word, year, corpus, genre: counts and texts, also of the kept texts only (a column of the index)."""
    rows = index if vocabulary is None else index.join(F.broadcast(vocabulary.select("word")), "word", "left_semi")
    kept = F.lit(True) if kept is None else kept
    return rows.groupBy("word", "year", "corpus", "genre").agg(
        F.sum("count").alias("word_count"), F.count("*").alias("n_texts"),
        F.coalesce(F.sum(F.when(kept, F.col("count"))), F.lit(0)).alias("word_count_dedup"), F.sum(F.when(kept, 1).otherwise(0)).alias("n_texts_dedup"),
    )


def totals(index: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """year, corpus, genre: texts that have a word of the vocabulary, and all their words."""
    per_text = index.groupBy("_id", "year", "corpus", "genre").agg(F.sum("count").alias("n"))
    if vocabulary is not None:
        known = index.join(F.broadcast(vocabulary.select("word")), "word", "left_semi").select("_id").distinct()
        per_text = per_text.join(known, "_id", "left_semi")
    return per_text.groupBy("year", "corpus", "genre").agg(F.count("*").alias("n_texts"), F.sum("n").alias("total_words"))


def series(index: DataFrame, words: list[str], n: int = 10, by: tuple = (), per_million: bool = True) -> DataFrame:
    """period, word (and by): value, raw_count, n_texts of words in periods of n years. One pass counts the words and
    the totals: the index is first summed to a row for each period and tracked word (others together)."""
    tracked = F.when(F.col("word").isin(*[w.lower() for w in words]), F.col("word"))
    keys = ["period", *by]
    rows = index.withColumn("period", T.year_bin("year", n)).withColumn("_w", tracked)
    small = rows.groupBy(*keys, "_w").agg(F.sum("count").alias("raw_count"), F.count("*").alias("n_texts"))
    counts = small.where("_w is not null").withColumnRenamed("_w", "word")
    if not per_million:
        return counts.withColumn("value", F.col("raw_count").cast("double"))
    total = small.groupBy(*keys).agg(F.sum("raw_count").alias("_total"))
    return counts.join(total, keys).select(*keys, "word", F.round(F.col("raw_count") * 1e6 / F.nullif(F.col("_total"), F.lit(0)), 6).alias("value"), "raw_count", "n_texts")


def terms(expression: str) -> list[tuple[str, list[tuple[str, int]]]]:
    """'a+b-c, d' as [('a+b-c', [('a', 1), ('b', 1), ('c', -1)]), ('d', [('d', 1)])]."""
    out = []
    for part in (p.strip().lower() for p in expression.split(",")):
        if part:
            out.append((part, [(w.strip(), -1 if sign == "-" else 1) for sign, w in re.findall(r"([+-]?)\s*([^+\s-][^+]*?)\s*(?=[+-]|$)", part)]))
    return out


def expression_series(index: DataFrame, expression: str, n: int = 10) -> DataFrame:
    """period and a column for each comma-separated sum of words (per million, signed)."""
    parsed = terms(expression)
    words = sorted({w for _, ws in parsed for w, _ in ws})
    rows = series(index, words, n)
    return rows.groupBy("period").agg(*[F.round(F.coalesce(F.sum(sum((F.when(F.col("word") == w, F.col("value") * s).otherwise(0.0) for w, s in ws), F.lit(0.0))), F.lit(0.0)), 6).alias(name) for name, ws in parsed])


def examples(index: DataFrame, word: str, n: int) -> DataFrame:
    """The texts in which a word is most frequent, per million."""
    own = index.groupBy("_id").agg(F.sum(F.when(F.col("word") == word, F.col("count"))).alias("count"), F.sum("count").alias("n_words")).where("count is not null")
    return own.withColumn("per_million", F.round(F.col("count") * 1e6 / F.col("n_words"), 6)).orderBy(F.col("per_million").desc(), "_id").limit(n)


def collocates(index: DataFrame, word: str, n: int) -> DataFrame:
    """The words that occur in most of the texts that have a word."""
    ids = index.where(F.col("word") == word).select("_id")
    rows = index.where(F.col("word") != word).join(ids, "_id", "left_semi")
    return rows.groupBy("word").agg(F.count("*").alias("n_texts"), F.sum("count").alias("n")).orderBy(F.col("n_texts").desc(), F.col("n").desc(), "word").limit(n)


def matrix(index: DataFrame, words: DataFrame) -> DataFrame:
    """Long document-term matrix over some words: _id, word, n, tf."""
    total = Window.partitionBy("_id")
    rows = index.select("_id", "word", F.col("count").alias("n")).join(F.broadcast(words.select("word")), "word", "left_semi")
    return rows.withColumn("tf", F.col("n") / F.sum("n").over(total))


def wide(long: DataFrame, words: list[str], value: str = "n") -> DataFrame:
    return long.groupBy("_id").pivot("word", words).agg(F.first(value)).na.fill(0)


def tfidf_smooth(long: DataFrame, n_texts: Column) -> DataFrame:
    """idf = ln((1 + N) / (1 + df)) + 1, rows of length 1."""
    df = long.groupBy("word").agg(F.count("*").alias("df"))
    raw = long.join(F.broadcast(df), "word").withColumn("w", F.col("n") * (F.log((1 + n_texts) / (1 + F.col("df"))) + 1))
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("_id"))))


def tfidf_log10(long: DataFrame, n_texts: Column) -> DataFrame:
    df = long.groupBy("word").agg(F.count("*").alias("df"))
    return long.join(F.broadcast(df), "word").withColumn("weight", F.col("tf") * F.log10(n_texts / F.col("df")))


def group_medians(long: DataFrame, groups: DataFrame, words: DataFrame) -> DataFrame:
    """group, word and the median tf of a group's texts, those that lack the word counting 0. Only texts that have the word
    are rows: a median is that of a sparse column, the zeros below it being a number. Values are counted first, so that
    what is ordered is a row for each value, not for each text."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("_size"))
    rows = long.join(groups, "_id").groupBy("group", "word", "tf").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy("group", "word").orderBy("tf").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("group", "word")
    ranked = rows.withColumn("_n", F.sum("_c").over(every)).withColumn("_upto", F.sum("_c").over(upto)).join(F.broadcast(sizes), "group")
    zeros = F.col("_size") - F.col("_n")
    holds = lambda place: (F.col("_upto") + zeros >= place) & (F.col("_upto") - F.col("_c") + zeros < place)
    value = lambda place: F.coalesce(F.max(F.when(holds(place), F.col("tf"))), F.lit(0.0))
    found = ranked.groupBy("group", "word").agg(((value(F.floor((F.col("_size") + 1) / 2)) + value(F.floor(F.col("_size") / 2) + 1)) / 2).alias("median"))
    return sizes.select("group").crossJoin(F.broadcast(words.select("word"))).join(found, ["group", "word"], "left").na.fill(0.0, ["median"])  # groups by words asked for


def mann_whitney(long: DataFrame, groups: DataFrame) -> DataFrame:
    """For each word and pair group1 < group2: U of group1 over all texts of both (0 where a text lacks the word), with
    mid-ranks for ties; z by the normal approximation with the correction for ties, its two-sided p, both means, and the
    group the word is distinctive of at 5 %. Only texts that have a word are rows: the zeros are one tied block."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("_n"))
    pairs = sizes.select(F.col("group").alias("group1"), F.col("_n").alias("na")).join(F.broadcast(sizes.select(F.col("group").alias("group2"), F.col("_n").alias("nb"))), F.col("group1") < F.col("group2"))  # groups are few
    values = long.join(groups, "_id").groupBy("word", "group", "tf").agg(F.count("*").alias("c"))
    rows = values.join(F.broadcast(pairs), (F.col("group") == F.col("group1")) | (F.col("group") == F.col("group2")))
    keys = ["word", "group1", "group2"]
    first = F.col("group") == F.col("group1")
    ties = rows.groupBy(*keys, "na", "nb", "tf").agg(F.sum(F.when(first, F.col("c")).otherwise(0)).alias("a"), F.sum("c").alias("t"))
    below = Window.partitionBy(*keys).orderBy("tf").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ties.withColumn("below", F.coalesce(F.sum("t").over(below), F.lit(0)))
    cube = lambda x: x.cast("double") * (x.cast("double") * x.cast("double") - 1)
    s = ranked.groupBy(*keys, "na", "nb").agg(
        F.sum(F.col("a") * (F.col("below") + (F.col("t") + 1) / 2)).alias("ranks"), F.sum("a").alias("a"), F.sum("t").alias("t"), F.sum(cube(F.col("t"))).alias("ties"),
        F.sum(F.col("a") * F.col("tf")).alias("sa"), F.sum((F.col("t") - F.col("a")) * F.col("tf")).alias("sb"),
    )
    # A word that neither group of a pair has isn't a difference between them, but is asked for
    s = long.select("word").distinct().join(F.broadcast(pairs)).join(s.drop("na", "nb"), keys, "left").na.fill(0)
    n = (F.col("na") + F.col("nb")).cast("double")
    zeros = F.col("na") + F.col("nb") - F.col("t")
    rank_sum = F.col("ranks") + F.col("a") * zeros + (F.col("na") - F.col("a")) * (zeros + 1) / 2
    u = rank_sum - F.col("na") * (F.col("na") + 1) / 2
    spread = F.sqrt(F.col("na") * F.col("nb") / 12 * (n + 1 - (F.col("ties") + cube(zeros)) / (n * (n - 1))))
    z = (u - F.col("na") * F.col("nb") / 2) / F.nullif(spread, F.lit(0.0))
    out = s.select(*keys, u.alias("u"), z.alias("z"), (F.col("sa") / F.col("na")).alias("group1_mean"), (F.col("sb") / F.col("nb")).alias("group2_mean"))
    out = out.withColumn("p", two_sided(F.col("z")))
    return out.withColumn("distinctive_of", F.when(F.col("p") <= 0.05, F.when(F.col("group1_mean") > F.col("group2_mean"), F.col("group1")).otherwise(F.col("group2"))))


def two_sided(z: Column) -> Column:
    """The probability of a standard normal value beyond +-z, by the rational approximation 7.1.26 of Abramowitz and Stegun
    (error below 1.5e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def fields(index: DataFrame, field_words: DataFrame) -> DataFrame:
    """_id, field: the counts of a field's words (field, word)."""
    return index.join(F.broadcast(field_words), "word").groupBy("_id", "field").agg(F.sum("count").alias("n"))


def known_share(index: DataFrame, words: DataFrame) -> DataFrame:
    """The share of each text's words that a dictionary has; null for a text without words."""
    known = index.join(F.broadcast(words.select("word").withColumn("_k", F.lit(1))), "word", "left")
    return known.groupBy("_id").agg((F.sum(F.when(F.col("_k").isNotNull(), F.col("count")).otherwise(0)) / F.nullif(F.sum("count"), F.lit(0))).alias("share"))


def kept_by(df: DataFrame, group: str, order: list) -> DataFrame:
    """One row for each group, the first in an order, among the rows given; rows without a group all stay."""
    first = Window.partitionBy(F.coalesce(F.col(group).cast("string"), F.concat(F.lit("-"), F.col("_id")))).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def modes(index: DataFrame) -> DataFrame:
    """The word index with its counts said in other ways: raw, presence, share of the text, and per million."""
    total = F.sum("count").over(Window.partitionBy("_id"))
    return index.select("_id", "word", F.col("count").alias("raw"), F.lit(1).alias("presence"), (F.col("count") / total).alias("share"), (F.col("count") * 1e6 / total).alias("per_million"))


def scaled_counts(long: DataFrame, column: str, by: int = 1_000_000) -> DataFrame:
    """A matrix's shares as whole numbers: a word whose least value is 1 or more stays, others are multiplied and cut."""
    least = F.min(column).over(Window.partitionBy("word"))
    return long.withColumn("scaled", F.when(least >= 1, F.col(column)).otherwise(F.floor(F.col(column) * by)).cast("long"))


def author_index(index: DataFrame, texts: DataFrame, author: str = "author") -> DataFrame:
    """author, word: the author's count of it and how many of the author's texts have it."""
    return index.join(texts.select("_id", author), "_id").groupBy(author, "word").agg(F.sum("count").alias("n"), F.count("*").alias("n_texts"))
