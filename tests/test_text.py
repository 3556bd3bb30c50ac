"""Scalar functions against tables of inputs and outputs."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import udfs


def each(spark, f, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.out for r in df.select("k", f(F.col("v")).alias("out")).orderBy("k").collect()]


def test_titles(spark):
    got = each(spark, T.normalize_title, ["The Life of Samuel Johnson", "", None, "nan", "A", "Pamela: or, Virtue Rewarded", "Clarissa; or the history", "[Love-Letters] between", "Mr. Smith goes", "Evelina a novel", "a novel thing", "Tom &amp; Jerry", "Q. K. Philander", "Emma by mrs"])
    assert got == ["the life of samuel johnson", None, None, None, None, "pamela", "clarissa", "love-letters between", "mr smith goes", "evelina", "a novel thing", "tom & jerry", "q k philander", "emma"]


def test_spelling_map(spark):
    modern = F.create_map(F.lit("vertue"), F.lit("virtue"))
    assert each(spark, lambda c: T.normalize_title(c, modern), ["Vertue Rewarded"]) == ["virtue rewarded"]


def test_authors(spark):
    assert each(spark, T.normalize_author, ["Congreve, William, 1670-1729.", "Shakespeare", "Defoe.", "", None, "nan"]) == ["congreve", "shakespeare", "defoe", None, None, None]


def test_years(spark):
    assert each(spark, T.parse_year, ["1750", "1750-1755", "[1750?]", "1750.0", None, "", "unknown", "c. 1750", "London 1750 x", "99-1800"]) == [1750, 1750, 1750, 1750, None, None, None, 1750, 1750, 1800]


def test_genres(spark):
    values = ["fic", "Fiction | Novel", "Novel | Novel, Gothic", "novel|Epistolary", "", None, "Non-Fiction", "poem | poem", "Letter | Epistolary novel"]
    assert each(spark, T.normalize_genre_raw, values) == ["Fiction", "Novel", "Novel, Gothic", "Novel, epistolary", None, None, "Nonfiction", "Poem", "Novel, epistolary"]


def test_tokens(spark):
    assert each(spark, T.tokens, ["Hello, World! How are you? -x- _y_ don't café"])[0] == ["hello", "world", "how", "are", "you", "x", "y", "don't", "café"]
    assert each(spark, lambda c: T.ngrams(T.tokens(c), 2), ["a b c", "a", ""]) == [["a b", "b c"], [], []]
    assert each(spark, lambda c: T.fixed_slices(T.tokens(c), 2), ["a b c d e", "a"]) == [[["a", "b"], ["c", "d"]], []]


def test_catalogue_numbers(spark):
    assert each(spark, T.estc_stripped, ["t068056", "N024384", "1785", "1790?", "027439", "T63646 [vols. 1-4]"]) == ["T68056", "N24384", "", "", "", "T63646"]
    assert each(spark, T.estc_padded, ["t68056", "N1"]) == ["T068056", "N000001"]


@pytest.mark.parametrize(
    ("raw", "pages", "volumes", "kind"),
    [("xi, [1], 216 p.", 228, None, "pages"), ("8p.", 8, None, "pages"), ("2v.", None, 2, "volumes"), ("1 sheet ([1] p.)", 1, None, "sheet"), (None, None, None, None), ("", None, None, None)],
)
def test_extent(raw, pages, volumes, kind):
    got = udfs.extent_of(raw)
    assert (got["num_pages"], got["num_volumes"], got["extent_type"]) == (pages, volumes, kind)


def test_plates_and_formats(spark):
    assert udfs.extent_of("216 p., plates")["has_plates"] is True
    assert udfs.format_of("8⁰")["format_std"] == "8⁰"
    assert udfs.format_of("folio")["format_std"] == "2⁰"
    assert udfs.format_of("4to")["format_std"] == "4⁰"
    got = udfs.format_of("34 x 21 cm")
    assert got["format_cm"] == "34 cm" and got["format_std"] is not None
    got = udfs.format_of("obl. 8⁰")
    assert got["format_std"] == "8⁰" and "obl" in got["format_modifier"]
    assert udfs.format_of(None)["format_std"] is None
    assert udfs.format_of(float("nan"))["format_std"] is None
    df = spark.createDataFrame([("xi p.",), (None,)], "raw string")
    assert [r.e.num_pages for r in df.select(udfs.extent("raw").alias("e")).collect()] == [11, None]


def test_jaro_winkler(spark):
    f = udfs.jaro_winkler_similarity
    assert f("abc", "abc") == 1.0 and f("", "abc") == 0.0 and f("", "") == 1.0
    assert f("martha", "marhta") > 0.9 and f("abc", "xyz") < 0.5
    assert round(f("dixon", "dicksonx"), 4) == 0.8133


def test_roman():
    assert [udfs.roman_value(x) for x in ("xiv", "MDCC", "iv", "q", "")] == [14, 1700, 4, None, None]


def test_xml():
    assert udfs.xml_blocks("<TEI><p><w reg='love'>loue</w><pc>,</pc> <w>me</w></p><p>two</p></TEI>") == "love, me\n\ntwo"
    assert udfs.xml_blocks("<p>a<b>") == "a"
    assert udfs.xml_blocks(None) is None


def test_mended(spark):
    df = spark.createDataFrame([("cafÃ©",), ("café",), (None,)], "t string")
    assert [r.m for r in df.select(udfs.mended("t").alias("m")).collect()] == ["café", "café", None]
    assert isinstance(pd.Series(["x"]), pd.Series)


def test_small_functions(spark):
    assert each(spark, T.short_author, ["Austen, Jane", "Clemens, Samuel (Mark Twain)", "Homer"]) == ["Jane Austen", "Mark Twain Clemens", "Homer"]
    assert each(spark, T.last_name, ["Austen, Jane", "Jane Austen"]) == ["Austen", "Austen"]
    assert each(spark, T.snake, ["My Corpus  Name!"]) == ["my_corpus_name"]
    assert each(spark, T.strip_marks, ["'(word)!'"]) == ["word"]
    assert each(spark, T.hyphens_joined, ["vir¬\n tue"]) == ["virtue"]
    assert each(spark, lambda c: T.tag_text(c, "head"), ["<div><head>One</head>x</div>"]) == ["One"]
    assert each(spark, T.gender, ["male", "F", "woman", ""]) == ["Male", "Female", "Female", "Indeterminate"]
    assert each(spark, T.unhtml, ["<p>a &amp; <b>b</b></p><script>x</script>"]) == ["a & b"]
