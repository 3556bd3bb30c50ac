"""Expressions over marked-up texts: headers, subtrees, speeches, graph files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, tag_text

#: Elements of a header's full bibliography, by column. Fixed values.
HEADER = {"author": "AUTHOR", "extent": "EXTENT", "pubplace": "PUBPLACE", "publisher": "PUBLISHER", "date": "DATE", "notes": "NOTESSTMT"}


def without_tags(text: Column | str, tags: list[str]) -> Column:
    """A text without elements of some names and what they hold, in any case; not for an element inside its own kind."""
    out = _c(text)
    for tag in tags:
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", "")
    return out


def header(text: Column | str) -> Column:
    """title, author, extent, pubplace, publisher, date, notes of a header's BIBLFULL; year: the date's first four digits,
    0 without any; ids: the ids after the file's own, which comes first, with their types."""
    full = tag_text(text, "BIBLFULL")
    values = {"title": F.regexp_extract(full, r"(?s)<TITLE\b[^>]*>(.*?)</TITLE>", 1)} | {c: tag_text(full, tag) for c, tag in HEADER.items()}
    digits = F.substring(F.regexp_replace(values["date"], r"\D", ""), 1, 4)
    every = F.regexp_extract_all(_c(text), F.lit(r'(?s)(<IDNO\b[^>]*TYPE="[^"]*"[^>]*>[^<]*)</IDNO>'), F.lit(1))
    pairs = F.slice(every, 2, F.greatest(F.size(every), F.lit(1)))
    entry = lambda x: F.struct(F.concat(F.lit("id_"), F.translate(F.regexp_extract(x, r'TYPE="([^"]*)"', 1), " ", "_")).alias("key"), F.regexp_extract(x, r"(?s)>(.*)$", 1).alias("value"))
    return F.struct(*[v.alias(c) for c, v in values.items()], F.coalesce(digits.try_cast("int"), F.lit(0)).alias("year"), F.transform(pairs, entry).alias("ids"))


def speeches(text: Column | str, tag: str = "u") -> Column:
    """What is said in a trial or play: the text of each such element on one line, a blank line between two."""
    inner = F.regexp_extract_all(_c(text), F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    line = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r"[\r\n ]+", " "))
    return F.btrim(F.array_join(F.transform(inner, line), "\n\n"), F.lit(" \n"))


def first_of(*values: Column) -> Column:
    """The first string that isn't blank, stripped, or ''."""
    return F.coalesce(*[F.nullif(F.btrim(v, F.lit(" \t\n\r")), F.lit("")) for v in values], F.lit(""))


def labelled(words: Column, label: Column) -> Column:
    """Words with a stream's label after each, so that streams have words of their own in one model."""
    return F.transform(words, lambda w: F.concat(w, F.lit("_"), label))


def escaped(value: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(sign), F.lit(name))
    return value


def unescaped(value: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        value = F.replace(value, F.lit(name), F.lit(sign))
    return value
