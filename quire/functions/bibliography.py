"""Bibliographic rules as column expressions. Word lists and mappings are parameters: every catalogue has its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _c, let


def imprint_year(value: Column | str) -> Column:
    """The first run of four digits."""
    return F.nullif(F.regexp_extract(_c(value), r"(\d{4})", 1), F.lit("")).cast("int")


def marc_year(value: Column | str) -> Column:
    """The leading four digits if they are a year from 1000 to 2100."""
    y = F.substring(_c(value), 1, 4).try_cast("int")
    return F.when(y.between(1000, 2100), y)


def years_of(meta: Column, keys: tuple = ("year", "date")) -> Column:
    """Distinct years, ascending, of the values of keys that begin with some words."""
    wanted = F.map_filter(meta, lambda k, v: F.exists(F.array(*[F.lit(x) for x in keys]), lambda p: k.startswith(p)))
    years = F.transform(F.map_values(wanted), lambda v: F.nullif(F.regexp_extract(v, r"(\d{4})", 1), F.lit("")).cast("int"))
    return F.array_sort(F.array_distinct(F.filter(years, lambda y: y.isNotNull())))


def representative_year(years: Column) -> Column:
    """The first of up to four years, the second of five, the median of more."""
    return let(years, lambda y: F.get(y, F.when(F.size(y) <= 4, 0).when(F.size(y) == 5, 1).otherwise(F.floor(F.size(y) / 2).cast("int"))))


def volume_id(value: Column | str) -> Column:
    """Library volume ids in one form: 'lib.ark+=13960=t0' and 'lib/ark:/13960/t0' alike."""
    v = F.regexp_replace(F.regexp_replace(F.trim(_c(value)), r"\.(json|txt|xml)(\.\w+)?$", ""), r"^([a-z0-9]+)/", "$1.")
    return F.when(v.contains("ark+="), F.replace(F.replace(F.replace(v, F.lit("ark+="), F.lit("ark:/")), F.lit("="), F.lit("/")), F.lit(","), F.lit("."))).otherwise(v)


def classified(df: DataFrame, rules: list[tuple[str, str, str]], tiers: tuple = ("form", "topic", "title")) -> DataFrame:
    """rules: (tier, lower-case keyword, genre). Adds genres (distinct, of the first tier whose column holds a keyword as a
    whole word) and genre_source. The rules are a literal: they are a list that people keep."""
    per_tier = []
    for t in tiers:
        if t not in df.columns or not any(r[0] == t for r in rules):
            continue
        text = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(F.col(t), F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
        hits = F.array(*[F.when(F.contains(text, F.lit(f" {k} ")), F.lit(g)) for tier, k, g in rules if tier == t])
        per_tier.append((t, F.array_sort(F.array_distinct(F.filter(hits, lambda x: x.isNotNull())))))
    genres, source = F.array().cast("array<string>"), F.lit(None).cast("string")
    for t, found in reversed(per_tier):
        genres, source = F.when(F.size(found) > 0, found).otherwise(genres), F.when(F.size(found) > 0, F.lit(t)).otherwise(source)
    return df.withColumn("genres", genres).withColumn("genre_source", source)


def harmonised(genres: Column, mapping: dict[str, str], priority: list[str]) -> Column:
    """The strongest of the broad genres that fine ones map to."""
    broad = F.transform(genres, lambda g: F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[g])
    return F.get(F.filter(F.array(*[F.lit(p) for p in priority]), lambda p: F.array_contains(F.filter(broad, lambda b: b.isNotNull()), p)), F.lit(0))


def translated(relators: Column, uniform_title: Column, title: Column) -> Column:
    """How a record shows to be a translation: by a relator, a language in the uniform title, or a phrase; else null."""
    by = F.exists(F.coalesce(relators, F.array().cast("array<string>")), lambda r: F.lower(r).rlike("translat"))
    return (
        F.when(by, "relator").when(F.coalesce(uniform_title, F.lit("")).rlike(r"(?i)\b(english|french|german|spanish|italian|latin)\.?\s*$"), "uniform_title")
        .when(F.coalesce(title, F.lit("")).rlike(r"(?i)\b(translated|done into english|englished|from the (french|german|spanish|italian|latin|greek))\b"), "phrase")
    )


def markup_genre(text: Column | str) -> Column:
    """Drama if over a hundred speakers' tags close, Verse if lines outnumber paragraphs, else Prose."""
    n = lambda tag: F.regexp_count(_c(text), F.lit(f"<{tag}\\b"))
    return F.when(F.regexp_count(_c(text), F.lit("</speaker>")) > 100, "Drama").when(n("l") > n("p"), "Verse").otherwise("Prose")


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: how alike two word lists are, shared words put first (by edit distance over the sorted words)."""
    text = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), " ")
    ratio = lambda x, y: F.when(F.greatest(F.length(x), F.length(y)) == 0, 100.0).otherwise(100 * (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))))
    both, left, right = text(F.array_intersect(a, b)), F.trim(F.concat_ws(" ", text(F.array_intersect(a, b)), text(F.array_except(a, b)))), F.trim(F.concat_ws(" ", text(F.array_intersect(a, b)), text(F.array_except(b, a))))
    return F.when(F.length(both) == 0, ratio(left, right)).otherwise(F.greatest(ratio(both, left), ratio(both, right), ratio(left, right)))


def variants(words: Column, spellings: Column) -> Column:
    """Every spelling of a phrase: spellings is a map of a word to its variants; unknown words stay as they are."""
    start = F.array(F.lit(""))
    return F.transform(
        F.aggregate(words, start, lambda done, w: F.flatten(F.transform(done, lambda d: F.transform(F.coalesce(spellings[w], F.array(w)), lambda v: F.concat_ws(" ", F.nullif(d, F.lit("")), v))))),
        lambda s: F.trim(s),
    )


def detokenised(words: Column) -> Column:
    """Words joined, punctuation closed up to what it belongs to."""
    return F.regexp_replace(F.regexp_replace(F.array_join(words, " "), r" ([.,;:!?)\]’”%])", "$1"), r"([(\[‘“$]) ", "$1")


def coerced(value: Column | str) -> Column:
    """Numbers of strings that begin with a digit; whole ones without a fraction; other strings as they are."""
    v = _c(value)
    n = F.when(v.rlike(r"^\d"), v.try_cast("double"))
    return F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(F.coalesce(n.cast("string"), v))


#: Genres that count as fiction.
FICTION = ("Fiction", "Novel", "Romance", "Tale", "Story", "Picaresque", "Novella")


def is_fiction(genres: Column, fiction: tuple[str, ...] = FICTION) -> Column:
    """Whether a record's genres hold one of fiction; no genres: false."""
    return F.coalesce(F.arrays_overlap(genres, F.array(*[F.lit(g) for g in fiction])), F.lit(False))


# What counts as prose and as verse
PROSE = ("Prose", "Non-Fiction", "Fiction", "Biography", "Oratory")
VERSE = ("Verse", "Poetry")


def prose_or_verse(*genres: Column) -> Column:
    """Prose or Verse by the first of several genres that tells; empty if none does."""
    told = [F.when(g.isin(*PROSE), "Prose").when(g.isin(*VERSE), "Verse") for g in genres]
    return F.coalesce(*told, F.lit(""))


_NOT_PAGES = "plate|map|table|port|leaf|leav|fold|chart|ill|front|genealog"
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman(text: Column) -> Column:
    """The value of a lower-case Roman numeral; null for anything else."""
    values = F.create_map(*[F.lit(x) for pair in _ROMAN.items() for x in pair])
    digits = F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.element_at(values, x))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    less = lambda a: F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1), lambda x, y: F.when(x < y, x).otherwise(0))
    return F.when(text.rlike("^[ivxlcdm]+$"), let(digits, lambda a: total(a) - 2 * total(less(a))))


def page_sum(extent: Column) -> Column:
    """Pages of an extent such as 'xi, [1], 216 p.': the sum of its numbers, Roman ones too; null if it has none. Plates,
    maps and leaves don't count."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(extent)), r"\]*\)*$", ""), r"\s*p\.?\s*$", "")

    def pages(part: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.trim(part), r"^[\[\]]+|[\[\]]+$", ""))
        number = F.regexp_extract(F.trim(part), r"^\[?(\d{1,9})\]?(\s*p\.?)?$", 1)
        return F.when(part.rlike(_NOT_PAGES), None).when(number != "", number.cast("int")).otherwise(roman(plain))

    found = F.filter(F.transform(F.split(bare, r"[;,]\s*"), pages), lambda x: x.isNotNull())
    return let(found, lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0), lambda s, x: s + x)))
