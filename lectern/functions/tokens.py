"""Words of a text, and their lemmas: one definition for the index, for queries, for stop words and for phrases.

A word is a letter or digit and the letters, digits and marks after it; in scripts without blanks between words (SEGMENTED) every
letter with its marks is a word of its own. The lemma is the word in lower case, letter by letter without marks, with letters that are written alike
made one. Python and the JVM read the same tables, so that they agree on composed and on decomposed text.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import fold_char

WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"
#: Scripts without blanks between words, by the language codes that read them; a corpus that names languages has those of its languages only.
SEGMENTED = {"Han": ("zho", "cmn", "jpn", "yue"), "Hiragana": ("jpn",), "Katakana": ("jpn",), "Thai": ("tha",), "Lao": ("lao",), "Khmer": ("khm",), "Myanmar": ("mya",)}

#: All segmented scripts stand from here on in Unicode.
FIRST_SEGMENTED = r"[\x{0E00}-\x{10FFFF}]"


def scripts(languages: list[str] | None = None) -> tuple[str, ...]:
    """The segmented scripts of some languages, or all."""
    return tuple(s for s, own in SEGMENTED.items() if languages is None or set(own) & set(languages))


def word_pattern(languages: list[str] | None = None) -> str:
    """The pattern of a word, for the JVM and the regex module."""
    alone = "".join(rf"\p{{Is{s}}}" for s in scripts(languages))
    if not alone:
        return WORD
    return rf"[{alone}&&[\p{{L}}\p{{N}}]]\p{{M}}*|[\p{{L}}\p{{N}}&&[^{alone}]][\p{{L}}\p{{N}}\p{{M}}&&[^{alone}]]*"


@functools.cache
def _compiled(languages: tuple[str, ...] | None) -> regex.Pattern:
    return regex.compile(word_pattern(None if languages is None else list(languages)), regex.VERSION1)


@functools.cache
def fold_table() -> dict[int, str]:
    """What a lower-case character becomes in a lemma: nothing for a mark, a letter or two for others. Hangul and other letters that fall apart stay."""
    out: dict[int, str] = {}
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or 0x1100 <= code < 0x1200 or 0xAC00 <= code < 0xD7B0 or c != c.lower():
            continue
        kind = unicodedata.category(c)
        if kind[0] not in "LNM":
            continue
        became = fold_char(c)
        if kind == "Mn" and not became:
            out[code] = ""
        elif became != c and (len(became) == 1 or len(became) <= 3 and (code < 0x250 or 0xFB00 <= code <= 0xFB06)):
            out[code] = became
    return out


def lemma(word: str) -> str:
    return word.lower().translate(fold_table())


def words(text: str, languages: list[str] | None = None) -> list[tuple[str, str, int, int]]:
    """(lemma, surface, start, end) of each word, in code points."""
    pattern = _compiled(None if languages is None else tuple(languages))
    return [(lemma(m[0]), m[0], m.start(), m.end()) for m in pattern.finditer(text)]


def lemmas(text: str, languages: list[str] | None = None) -> list[str]:
    return [w[0] for w in words(text, languages)]


def lemma_column(c: Column) -> Column:
    """The lemma of each word, in the JVM."""
    table = fold_table()
    one = {k: v for k, v in table.items() if len(v) == 1}
    gone = [k for k, v in table.items() if not v]
    several = {chr(k): v for k, v in table.items() if len(v) > 1}
    low = F.lower(c)
    spread = low
    for k, v in several.items():
        spread = F.replace(spread, F.lit(k), F.lit(v))
    low = F.when(low.rlike(f"[{''.join(several)}]"), spread).otherwise(low)
    folded = F.translate(low, "".join(map(chr, [*one, *gone])), "".join(one.values()))
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(c))


def may_hold(c: Column, asked: Iterable[str]) -> Column:
    """False only for texts without a word of these lemmas, found without cutting them: a word in ASCII is its lemma but for case, and others are in no ASCII text."""
    out = c.rlike(r"[^\x00-\x7F]")
    for w in sorted(set(asked)):
        out = out | F.lower(c).contains(w)
    return out


def word_array(c: Column) -> Column:
    """The lemmas of the words of a text, in the JVM."""
    return F.transform(surface_array(c), lemma_column)


def _matches(c: Column, more: str, languages: list[str] | None) -> Column:
    """All matches of a word or of `more`. Text below the segmented scripts takes the plain pattern, which is faster and finds the same."""
    plain, full = (F.regexp_extract_all(c, F.lit(p + more), F.lit(0)) for p in (WORD, word_pattern(languages)))
    return F.when(c.rlike(FIRST_SEGMENTED), full).otherwise(plain) if scripts(languages) else plain


def surface_array(c: Column, languages: list[str] | None = None) -> Column:
    return _matches(c, "", languages)


def run_array(c: Column, languages: list[str] | None = None) -> Column:
    """The words and what lies between them, in order."""
    return _matches(c, r"|[^\p{L}\p{N}]+", languages)


def sentence_array(c: Column) -> Column:
    """The sentences of a line, each with its closing signs."""
    return F.regexp_extract_all(c, F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
