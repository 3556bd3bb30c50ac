"""Functions that column expressions can't say, as Arrow-batched pandas functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType


def jaro_winkler_similarity(a: str, b: str) -> float:
    """Whole transpositions (halves rounded down); the prefix counts only above 0.7. Two empty strings are equal."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    pairs = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                pairs.append(x)
                break
    if not pairs:
        return 0.0
    other = [y for y, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(pairs, other, strict=True)) // 2
    m = len(pairs)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def jaro_winkler_bound(a: np.ndarray, b: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    """What the similarity of a string (code points a) to many (rows of b, of `sizes` characters, then -1) is at most:
    characters match at most as often as both hold them, and none is transposed."""
    most = sum(np.minimum(int((a == c).sum()), (b == c).sum(axis=1)) for c in set(a.tolist()))
    wide = min(4, n, b.shape[1])
    prefix = np.cumprod(b[:, :wide] == a[:wide], axis=1).sum(axis=1)
    jaro = np.where(most > 0, (most / n + most / np.maximum(sizes, 1) + 1) / 3, 0.0)
    return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro) + 1e-9


def most_alike(a: str, others: list[str], codes: np.ndarray, sizes: np.ndarray, keys: np.ndarray, there: np.ndarray, least: float) -> tuple[int, float] | None:
    """The key and Jaro-Winkler similarity of the string most like a of those of at least that similarity; of equally
    similar ones the smallest key. `there`: which strings count. Strings are compared from the highest bound down, until no bound reaches the best."""
    if not len(others):
        return None
    bound = jaro_winkler_bound(np.fromiter(map(ord, a), np.int32, len(a)), codes, len(a), sizes) if a else np.ones(len(others))
    bound = np.where(there, bound, -1.0)
    best, key = least, None
    for k in np.argsort(-bound, kind="stable"):
        if bound[k] < max(best, 0):
            break
        score = jaro_winkler_similarity(a, others[k])
        if score > best or score == best and (key is None or keys[k] < key):
            best, key = score, int(keys[k])
    return None if key is None else (key, best)


_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman_value(text: str) -> int | None:
    """The value of a Roman numeral up to 5000; None if it isn't one."""
    t = text.strip().lower()
    if not t or any(c not in _ROMAN for c in t):
        return None
    values = [_ROMAN[c] for c in t]
    total = sum(-v if any(v < w for w in values[k + 1 : k + 2]) else v for k, v in enumerate(values))
    return total if 0 < total <= 5000 else None


def extent_of(raw: str | None) -> dict:
    """Pages, volumes and plates of a catalogue's extent, as in 'xi, [1], 216 p.'"""
    out = {"num_pages": None, "num_volumes": None, "extent_type": None, "has_plates": None}
    if not isinstance(raw, str) or not raw.strip():
        return out
    t = raw.lower()
    out["has_plates"] = bool(re.search(r"plates?\b", t))
    volumes = re.search(r"(\d+)\s*v\b", t)
    sheet = re.search(r"\b(sheet|broadside|folded)", t)
    body = re.sub(r"\([^)]*\bplates?\b[^)]*\)|,?\s*(\[?\d+\]?|[ivxlc]+)?\s*(leaves of\s*)?plates?\b.*", "", t)
    pages = re.search(r"([\[\]ivxlcdm\d,\s]*)p\b", body)
    if pages and re.search(r"[\divxlcdm]", pages[1]):
        n = 0
        for part in re.split(r"[,\s]+", pages[1]):
            part = part.strip("[]")
            if part.isdigit():
                n += int(part)
            elif part:
                n += roman_value(part) or 0
        out["num_pages"] = n
        out["extent_type"] = "pages"
    if volumes:
        out["num_volumes"] = int(volumes[1])
        out["extent_type"] = "volumes"
    if sheet:
        out["extent_type"] = "sheet"
    return out


@F.pandas_udf(StructType([StructField("num_pages", IntegerType()), StructField("num_volumes", IntegerType()), StructField("extent_type", StringType()), StructField("has_plates", BooleanType())]))
def extent(raw: pd.Series) -> pd.DataFrame:
    rows = pd.DataFrame([extent_of(x) for x in raw], columns=["num_pages", "num_volumes", "extent_type", "has_plates"])
    return rows.astype({"num_pages": "Int32", "num_volumes": "Int32", "has_plates": "boolean"})


#: Names of book formats. Fixed values.
FORMATS = {"folio": "2", "fol": "2", "quarto": "4", "4to": "4", "octavo": "8", "8vo": "8", "duodecimo": "12", "12mo": "12", "16mo": "16", "18mo": "18", "24mo": "24", "32mo": "32", "64mo": "64"}


def format_of(raw: str | None) -> dict:
    """A book's standard format, what qualifies it, and its height in centimetres with the format that suggests."""
    out = {"format_std": None, "format_modifier": None, "format_cm": None}
    if not isinstance(raw, str) or not raw.strip():
        return out
    t = raw.lower()
    if modifier := re.search(r"\b(obl|long|large|small|fol\. obl)\b\.?", t):
        out["format_modifier"] = modifier[0]
    if size := re.search(r"\b(1|2|4|6|8|12|16|18|24|32|48|64)\s*(⁰|º|°|o\b|mo\b|to\b|vo\b)", t):
        out["format_std"] = size[1] + "⁰"
    else:
        for name, n in FORMATS.items():
            if re.search(rf"\b{name}\b", t):
                out["format_std"] = n + "⁰"
                break
    if cm := re.search(r"(\d+)(?:\s*x\s*\d+)?\s*cm", t):
        out["format_cm"] = f"{cm[1]} cm"
        if out["format_std"] is None:
            height = int(cm[1])
            out["format_std"] = ("2" if height >= 30 else "4" if height >= 23 else "8" if height >= 18 else "12") + "⁰"
    return out


@F.pandas_udf(StructType([StructField(c, StringType()) for c in ("format_std", "format_modifier", "format_cm")]))
def book_format(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([format_of(x) for x in raw], columns=["format_std", "format_modifier", "format_cm"])


def xml_blocks(raw: str | None, blocks: tuple = ("p", "l"), words: str = "w", points: str = "pc", regular: str = "reg") -> str | None:
    """The text of a TEI-like document: blocks parted by empty lines; regularised words, points joined to what precedes."""
    if not raw:
        return raw
    try:
        root = ElementTree.fromstring(re.sub(r"\sxmlns(:\w+)?=\"[^\"]*\"", "", raw))
    except ElementTree.ParseError:
        return " ".join(re.sub(r"<[^>]*>", " ", raw).split())
    found = [e for e in root.iter() if e.tag in blocks] or [root]
    out = []
    for block in found:
        tokens = [e for e in block.iter() if e.tag in (words, points)]
        if tokens:
            text = ""
            for e in tokens:
                own = e.get(regular) or "".join(e.itertext()).strip()
                text += own if e.tag == points or not text else f" {own}"
        else:
            text = " ".join("".join(block.itertext()).split())
        if text:
            out.append(text)
    return "\n\n".join(out)


@F.pandas_udf(StringType())
def xml_to_text(raw: pd.Series) -> pd.Series:
    return raw.map(xml_blocks)


@F.pandas_udf(StringType())
def mended(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """UTF-8 that was read as Windows-1252 once, read right; other texts unchanged."""

    def mend(t):
        if not t or not re.search("[ÂÃâ]", t):
            return t
        try:
            return t.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return t

    for text in texts:
        yield text.map(mend)
