"""Normalisation of queries and names, with the way back to the source text.

The full form decomposes compatibly, folds case, kana, ligatures, quotes, Arabic and Persian letters, Vietnamese đ and Turkish ı, and drops
controls, marks and white space. Swedish and Persian differ from other languages of their scripts, so they count where they are named:
Swedish keeps å, ä and ö, and Persian has its own yeh and kaf where Arabic has others. Variants of Chinese signs become one where Unicode holds
them as compatible; further tables of variants are not part of Python. `normalize_column` is the column form; `fold` stays in the JVM and suits
composed Latin text.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that are written alike.
SAME = {"æ": "ae", "œ": "oe", "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "«": '"', "»": '"'}
KATAKANA_LOW, KATAKANA_HIGH, KANA_SHIFT = 0x30A1, 0x30F6, 0x60
#: Voiced sound marks belong to the letter. Of other marks, those of these scripts (by their names) are dropped; elsewhere marks are vowels.
KEPT_MARKS = "゙゚"
DROPPED_MARKS = ("COMBINING", "HEBREW", "ARABIC", "THAI")
#: Letters that are written alike: forms of alef, yeh and teh, the stretching sign, Vietnamese and Turkish letters; Persian has others of the first.
ARABIC = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ی": "ي", "ک": "ك", "ة": "ه", "ـ": "", "đ": "d", "ı": "i"}
PERSIAN = ARABIC | {"ى": "ی", "ي": "ی", "ی": "ی", "ك": "ک", "ک": "ک"}
SWEDISH = frozenset("åäöÅÄÖ")


def fold_char(c: str, languages: frozenset[str] = frozenset()) -> str:
    """What a character becomes; empty where it vanishes."""
    if c in SWEDISH and "swe" in languages:
        return c.lower()
    letters = PERSIAN if "pes" in languages or "fas" in languages else ARABIC
    out = []
    for d in unicodedata.normalize("NFKD", letters.get(c, c)).lower():
        d = SAME.get(d, letters.get(d, d))
        for e in d:
            code = ord(e)
            if KATAKANA_LOW <= code <= KATAKANA_HIGH:
                e = chr(code - KANA_SHIFT)
            kind = unicodedata.category(e)
            if e.isspace() or kind == "Cc" or kind == "Mn" and e not in KEPT_MARKS and unicodedata.name(e, "").startswith(DROPPED_MARKS):
                continue
            out.append(e)
    return unicodedata.normalize("NFC", "".join(out)) if any(m in out for m in KEPT_MARKS) else "".join(out)


def normalize(text: str, languages: list[str] | None = None) -> tuple[str, list[int]]:
    """The normalised text, and for each of its characters and its end the place in the source."""
    out, places, named = [], [], frozenset(languages or ())
    if "swe" in named:  # letters that are decomposed are put together first, at the place of the letter
        text = re.sub("([aoAO])([\u0308\u030a])", lambda m: unicodedata.normalize("NFC", m[0]).ljust(2, "\u0301"), text)
    for i, c in enumerate(text):
        for d in fold_char(c, named):
            out.append(d)
            places.append(i)
    return "".join(out), [*places, len(text)]


def normalize_key(text: str, languages: list[str] | None = None) -> str:
    return normalize(text, languages)[0]


def byte_map(text: str) -> list[int | None]:
    """The same map between bytes: of each normalised byte the source byte, None within a character, and the end."""
    norm, places = normalize(text)
    starts = [0]
    for c in text:
        starts.append(starts[-1] + len(c.encode()))
    out: list[int | None] = []
    for c, p in zip(norm, places, strict=False):
        out += [starts[p], *[None] * (len(c.encode()) - 1)]
    return [*out, starts[-1]]


def source_slice(text: str, places: list[int], start: int, end: int) -> str:
    """The source of a stretch of normalised text, trimmed."""
    return text[places[start] : places[end]].strip() if end > start else ""


def normalize_column(c: Column) -> Column:
    @F.pandas_udf("string")
    def fold_all(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else normalize_key(t))

    return fold_all(c)


def fold(c: Column) -> Column:
    """The JVM form for composed Latin text: lower case without white space."""
    return F.lower(F.regexp_replace(c, r"\s", ""))
