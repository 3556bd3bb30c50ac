"""Scalar and array functions over strings, as Spark column expressions (names of columns or columns in, columns out).

All are null-safe: null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

WORD = r"[\p{L}\p{N}_'\-]+"
VALID_WORD = r"^\p{L}[\p{L}'\-]*$"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tokens(text: Column | str) -> Column:
    """Lower-case words of a text, in order: letters, digits, `_'-`, without `_'-` at the ends."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(f"({WORD})"), 1)
    return F.filter(F.transform(found, lambda x: F.btrim(x, F.lit("_'-"))), lambda x: x != "")


def agnostic_tokens(text: Column | str) -> Column:
    """Words and the runs between them, in order."""
    return F.regexp_extract_all(_c(text), F.lit(r"([\p{L}\p{N}']+|[^\p{L}\p{N}']+)"), 1)


def is_word(word: Column | str) -> Column:
    return _c(word).rlike(VALID_WORD)


def whitespace_words(text: Column | str) -> Column:
    return F.filter(F.split(_c(text), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")


def sentences(text: Column | str) -> Column:
    """Sentences by final punctuation followed by white space; kept with their punctuation."""
    return F.filter(F.transform(F.split(F.regexp_replace(_c(text), r"([.!?]+)[ \t\n\x0B\f\r]+", "$1\u0001"), "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def ngrams(words: Column, n: int, separator: str = " ") -> Column:
    def of(w: Column) -> Column:
        spans = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(spans, lambda i: F.array_join(F.slice(w, i, n), separator))

    return let(words, of)


def fixed_slices(words: Column, n: int) -> Column:
    """Consecutive slices of n words; a shorter rest is dropped."""

    def of(w: Column) -> Column:
        whole = F.floor(F.size(w) / n).cast("int")
        spans = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(spans, lambda i: F.slice(w, i * n + 1, n))

    return let(words, of)


def paragraphs(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(text), "\n[ \t]*\n"), lambda x: F.trim(x)), lambda x: x != "")


def unhtml(text: Column | str) -> Column:
    out = F.regexp_replace(_c(text), r"(?s)<(script|style)\b.*?</(script|style)>", " ")
    return clean_text(F.regexp_replace(out, r"<[^>]*>", " "))


def clean_text(text: Column | str) -> Column:
    """Entities replaced, runs of blanks squeezed."""
    out = _c(text)
    for entity, char in V.ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t]+", " "))


def normalize_title(title: Column | str, modern: Column | None = None, blanks_shared: bool = True) -> Column:
    """The key that titles are matched by; null if shorter than two characters. modern: a map of old to new spellings.
    blanks_shared: a blank may end one abbreviation and begin the next, so that all of `rev. dr. x` lose their periods;
    else, as in the SQL of the query normalize_title, only every second of abbreviations in a row does."""
    t = F.lower(F.trim(_c(title)))
    for entity, char in V.ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[‐‑‒–—―−﹘﹣－]", "-")
    t = F.replace(t, F.lit("--"), F.lit(" "))
    t = F.trim(F.regexp_replace(t, r"[\[\]]", ""))
    t = F.regexp_replace(t, r"(?U)\b([a-z])\.\s", "$1 ")
    abbreviations = "|".join(V.ABBREVIATIONS)
    if blanks_shared:
        t = F.regexp_replace(t, rf"(?U)\b({abbreviations})\.(\s|$)", "$1 ")
    else:
        t = F.regexp_replace(t, rf"(^|[^\p{{L}}\p{{N}}_])({abbreviations})\.([\t\n\f\r ]|$)", "$1$2 ")
    if modern is not None:
        t = F.array_join(F.transform(whitespace_words(t), lambda w: F.coalesce(modern[w], w)), " ")
    phrases = F.array(*[F.lit(p) for p in V.TITLE_END_PHRASES])

    def ended(t: Column) -> Column:
        at_mark = F.trim(F.regexp_extract(t, r"^([^;:.(\[,!?]*)", 1))
        phrase = F.get(F.filter(phrases, lambda p: F.position(p, t) > 4), F.lit(0))
        at_phrase = let(phrase, lambda p: F.when(p.isNotNull(), F.trim(F.substring(t, F.lit(1), (F.position(p, t) - 1).cast("int")))).otherwise(t))
        return F.when(t.rlike(r"[;:.(\[,!?]"), at_mark).otherwise(at_phrase)

    t = F.trim(F.regexp_replace(F.rtrim(let(t, ended), F.lit(". ")), r"\s+", " "))
    return let(t, lambda t: F.when((F.length(t) > 1) & (_c(title) != "nan"), t))


def normalize_author(author: Column | str) -> Column:
    a = F.trim(F.substring_index(F.lower(F.trim(_c(author))), ",", 1))
    a = F.trim(F.regexp_replace(F.rtrim(a, F.lit(".")), r"\s+", " "))
    return F.when((F.length(a) > 1) & (_c(author) != "nan"), a)


def normalize_genre_raw(value: Column | str) -> Column:
    v = F.trim(_c(value))
    code = F.create_map(*[F.lit(x) for kv in V.GENRE_CODES.items() for x in kv])
    terms = F.filter(F.split(v, r"\s*\|\s*"), lambda p: p != "")
    terms = F.transform(terms, lambda p: F.coalesce(code[p], p))
    terms = F.transform(terms, lambda p: F.when(p.isin(*V.EPISTOLARY), F.lit("Novel, epistolary")).otherwise(p))
    terms = F.array_distinct(F.transform(terms, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 10_000))))
    has = lambda kinds: F.exists(terms, lambda p: p.isin(*kinds))
    many = F.size(terms) > 1
    goes = lambda p: (many & has(V.FICTION_KINDS) & (p == "Fiction")) | (many & has(V.NOVEL_KINDS) & (p == "Novel")) | (many & has(("Novel, epistolary",)) & (p == "Letter"))
    joined = F.array_join(F.filter(terms, lambda p: ~goes(p)), " | ")
    return F.when(v.isin("nan", "None", ""), None).otherwise(F.coalesce(code[v], F.when(joined != "", joined)))


def parse_year(value: Column | str) -> Column:
    """The year of a number, an approximate date or a range's first plausible year; else the first four-digit number."""
    s = F.trim(_c(value).cast("string"))
    for mark in ("c.", "c ", "ca.", "ca ", "[", "]", "?", "~"):
        s = F.replace(s, F.lit(mark), F.lit(""))
    s = F.trim(s)
    number = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double").cast("int"))
    parts = F.filter(F.transform(F.split(s, "-"), lambda p: F.trim(p)), lambda p: p != "")
    numeric = F.forall(parts, lambda p: p.rlike(r"^\d+(\.\d+)?$"))
    years = F.filter(F.transform(parts, lambda p: p.try_cast("double").cast("int")), lambda y: (y > 100) & (y < 2100))
    first = F.when(s.contains("-") & numeric & (F.size(years) > 0), F.get(years, F.lit(0)))
    four = F.nullif(F.regexp_extract(s, r"\b(\d{4})\b", 1), F.lit("")).cast("int")
    return F.when(s.isin("", "nan", "None"), None).otherwise(F.coalesce(number, first, four))


def year_bin(year: Column | str, n: int) -> Column:
    return (F.floor(_c(year) / n) * n).cast("int")


def year_label(year: Column | str, n: int) -> Column:
    return F.format_string("%04d-%04d", year_bin(year, n), year_bin(year, n) + n)


def short_author(author: Column | str) -> Column:
    """'Last, First (X)' as 'X Last', 'Last, First' as 'First Last'."""
    a = F.trim(_c(author))
    last, first = F.trim(F.substring_index(a, ",", 1)), F.trim(F.regexp_extract(a, r",([^,(]*)", 1))
    alias = F.trim(F.regexp_extract(a, r"\(([^)]*)\)", 1))
    given = F.when(alias != "", alias).otherwise(first)
    return F.when(a.contains(","), F.trim(F.concat_ws(" ", given, last))).otherwise(a)


def last_name(author: Column | str) -> Column:
    a = F.trim(_c(author))
    return F.when(a.contains(","), F.trim(F.substring_index(a, ",", 1))).otherwise(F.substring_index(a, " ", -1))


def alnum(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"[^\p{L}\p{N}]", "")


def author_key(author: Column | str) -> Column:
    return alnum(last_name(author))


def title_key(title: Column | str) -> Column:
    return F.substring(alnum(F.initcap(F.substring(_c(title), 1, 30))), 1, 25)


def strip_marks(text: Column | str) -> Column:
    return F.btrim(_c(text), F.lit(MARKS))


def snake(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(text))), " ", "_"), r"[^\p{L}\p{N}_]", ""), "__+", "_")


def estc_padded(value: Column | str) -> Column:
    """A catalogue number as its letter and six digits; null unless it is one."""
    v = F.upper(F.trim(F.regexp_replace(_c(value), r"^\(?\w*\)?(?=[A-Za-z]\d)", "")))
    return F.when(v.rlike(r"^[A-Z]\d{1,6}$"), F.concat(F.substring(v, 1, 1), F.lpad(F.substring(v, 2, 6), 6, "0")))


def estc_stripped(value: Column | str) -> Column:
    """The first catalogue number in a string, without leading zeros; '' if there is none."""
    v = F.upper(F.coalesce(_c(value), F.lit("")))
    return F.concat(F.regexp_extract(v, r"\b([A-Z])0*([1-9]\d*)\b", 1), F.regexp_extract(v, r"\b([A-Z])0*([1-9]\d*)\b", 2))


def hyphens_joined(text: Column | str) -> Column:
    """Words broken at a line's end with a not-sign are joined."""
    return F.regexp_replace(_c(text), "¬[ \t]*\n[ \t]*", "")


def tag_text(text: Column | str, tag: str) -> Column:
    return F.regexp_extract(_c(text), rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)


def gender(value: Column | str) -> Column:
    v = F.lower(F.trim(_c(value)))
    return F.when(v.startswith("m"), "Male").when(v.startswith("f") | v.startswith("w"), "Female").otherwise("Indeterminate")


def short_title(title: Column | str) -> Column:
    """A title up to its first mark, or to a phrase that ends titles, in title case; after Mr, Mrs and Dr a mark doesn't
    end it. Longer phrases first."""
    t = F.initcap(F.trim(F.replace(F.replace(_c(title), F.lit("—"), F.lit("--")), F.lit("–"), F.lit("-"))))
    t = F.replace(t, F.lit(" S "), F.lit("'s "))

    def until(mark: str):
        def cut(v: Column) -> Column:
            return let(F.trim(F.substring_index(v, mark, 1)), lambda head: F.when(head.isin("Mrs", "Mr", "Dr"), v).otherwise(head))

        return cut

    def marks(value: Column) -> Column:
        for mark in V.TITLE_MARKS:
            value = let(value, until(mark))
        return value

    def phrases(value: Column) -> Column:
        for phrase in sorted(V.SHORT_TITLE_ENDS, key=lambda p: (-len(p), p)):
            value = F.trim(F.substring_index(value, phrase, 1))
        return value

    return let(t, lambda v: F.trim(F.when(v.rlike("[:;.(\\[,!?]"), marks(v)).otherwise(phrases(v))))


def phrase_places(text: Column | str, phrase: str) -> Column:
    """Where a phrase (a regular expression) begins and ends in a text, ignoring case: code points from 0."""
    mark = ""
    pieces = F.split(F.regexp_replace(F.translate(_c(text), mark, " "), f"(?i)({phrase})", f"{mark}$1{mark}"), mark)
    ends = F.aggregate(pieces, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    return let(F.struct(pieces.alias("p"), ends.alias("e")), lambda s: F.transform(F.when(F.size(s["p"]) > 1, F.sequence(F.lit(1), F.size(s["p"]) - 2, F.lit(2))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.get(s["e"], i).alias("start"), F.get(s["e"], i + 1).alias("end"))))


def hashed(text: Column | str) -> Column:
    """SHA-224, in hex."""
    return F.sha2(_c(text), 224)


def split_keeping(text: Column | str, separator: str) -> Column:
    """Pieces of a text, each but the last with the separator that follows it."""
    pieces = F.split(_c(text), "\\Q" + separator + "\\E", -1)
    return let(pieces, lambda p: F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, F.concat(x, F.lit(separator))).otherwise(x)))


def pipe_joined(values: Column | str) -> Column:
    """An array's strings, stripped, without empty ones and nulls."""
    stripped = F.transform(_c(values), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(stripped, lambda x: x != ""), "|")


def marks_cut(text: Column | str) -> Column:
    """A catalogue field without the marks at its end."""
    return F.rtrim(_c(text), F.lit(" /.:,;"))
