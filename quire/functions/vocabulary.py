"""Controlled vocabularies. Every list here is a set of fixed values that results depend on."""

from __future__ import annotations

GENRES = ("Fiction", "Poetry", "Drama", "Periodical", "Essay", "Treatise", "Letters", "Sermon", "Biography", "Nonfiction", "Legal", "Speech", "Spoken", "History", "Criticism", "Academic", "Almanac", "Reference")

CORE_COLUMNS = ("_id", "corpus", "id", "title", "author", "year", "genre", "genre_raw", "is_translated", "title_norm", "author_norm", "path_freqs")

#: Phrases that end a title, tried from the longest on.
TITLE_END_PHRASES = tuple(
    sorted(
        (
            "edited by", "written by", "by the author", "by mr", "by mrs",
            "by miss", "by dr", "a novel", "a romance", "a tale", "a poem",
            "a tragedy", "a comedy", "a farce", "in two volumes", "in three volumes",
            "in four volumes", "the second edition", "the third edition",
            "the fourth edition", "a new edition", "translated from",
            "translated by", "with a preface", "with an introduction",
        ),
        key=len,
        reverse=True,
    )
)

#: Abbreviations whose period doesn't end a title.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "st", "sr", "jr", "esq", "rev", "gen", "col", "capt", "maj", "sgt", "vol", "pt", "no", "ed", "edn")

GENRE_CODES = {"FIC": "Fiction", "fic": "Fiction", "NEWS": "News", "MAG": "Magazine", "ACAD": "Academic", "SPOK": "Spoken", "bio": "Biography", "Non-Fiction": "Nonfiction", "Non-fiction": "Nonfiction"}
EPISTOLARY = ("Epistolary fiction", "Epistolary", "Epistolary novel")
FICTION_KINDS = ("Novel", "Novel, epistolary", "Romance", "Tale", "Fable", "Novella", "Picaresque", "Gothic", "Imaginary voyage", "Silver Fork", "Bildungsroman", "New Woman", "Rogue fiction", "Chapbook", "It Narrative", "Utopia", "Jestbook")
NOVEL_KINDS = (
    "Novel, epistolary", "Novel, sentimental", "Novel, Gothic", "Novel, picaresque", "Novel, satire", "Novel, historical",
    "Novel, didactic", "Novel, oriental", "Novel, utopian", "Novel, utopia", "Novel, erotic", "Novel, philosophical",
    "Novel, anti-Jacobin", "Novel, satirical", "Novel, It Narrative", "Novel, scandalous memoir",
    "Novel, scandal chronicle", "Novel, secret history", "Novel, miscellany", "Novel, Romance",
)
#: Raw genres that stay when an authority says Fiction.
KEPT_AS_FICTION = (
    "Fiction", "Novel", "Novel, epistolary", "Romance", "Tale", "Fable", "Novella", "Picaresque", "Gothic", "Imaginary voyage",
    "Satire", "Dialogue", "Allegory", "Epistolary fiction", "Novel, sentimental", "Novel, Gothic", "Novel, satire",
    "Novel, historical", "Novel, didactic", "Novel, oriental",
)

#: HTML entities that titles and texts are cleaned of.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&hyphen;": "-"}

# What ends a short title (marks, in the order they are looked for; phrases in title case).
TITLE_MARKS = (":", ";", ".", "(", "[", ",", "!", "?")
SHORT_TITLE_ENDS = (
    "Edited By", "Written By", "A Novel", "A Tale", "A Romance", "A History", "A Story", "A Domestic Tale", "By The Author",
    "By A Lady", "Being Some", "By Miss", "By Mr", "An Historical", "The Autobiography", "Being", " By ", " Or",
)
