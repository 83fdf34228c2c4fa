"""Markers, verse ranges and identifiers of marked-up documents."""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the USFM standard: paragraph markers, with the largest number each may carry (0: none).
PARA = (
    "ide 0 sts 0 rem 0 h 3 toc 3 toca 3 usfm 0 "
    "imt 4 is 3 ip 0 ipi 0 im 0 imi 0 ipq 0 imq 0 ipr 0 iq 3 ib 0 ili 2 iot 0 io 4 iex 0 imte 3 ie 0 "
    "mt 4 mte 4 cl 0 cp 0 cd 0 ms 3 mr 0 s 4 sr 0 r 0 d 0 sp 0 sd 4 "
    "p 0 m 0 po 0 pr 0 cls 0 pmo 0 pm 0 pmc 0 pmr 0 pi 3 mi 0 nb 0 pc 0 ph 3 b 0 "
    "q 4 qr 0 qc 0 qa 0 qm 3 qd 0 lh 0 li 4 lf 0 lim 4 lit 0 k1 0 k2 0"
)
CHAR = (
    "add 0 bk 0 dc 0 k 0 lit 0 nd 0 ord 0 pn 0 png 0 addpn 0 qt 0 sig 0 sls 0 tl 0 wj 0 em 0 bd 0 it 0 bdit 0 no 0 sc 0 sup 0 fig 0 ndx 0 rb 0 pro 0 w 0 wg 0 wh 0 "
    "wa 0 jmp 0 ior 0 iqt 0 rq 0 ca 0 cp 0 va 0 vp 0 qs 0 qac 0 litl 0 lik 0 liv 5 ref 0 cat 0 "
    "fr 0 fq 0 fqa 0 fk 0 fl 0 fw 0 fp 0 fv 0 ft 0 fdc 0 fm 0 xo 0 xop 0 xk 0 xq 0 xt 0 xta 0 xot 0 xnt 0 xdc 0 rt 0"
)
CELL = "th 12 thr 12 thc 12 tc 12 tcr 12 tcc 12"
NOTES = ("f", "fe", "ef", "x", "ex")
TITLES = ("mt", "mte", "ms", "mr", "s", "r", "d", "sp", "sd", "sr")
ALIGN = {"r": "end", "c": "center"}


def _largest(spec: str) -> dict[str, int]:
    items = spec.split()
    return dict(zip(items[::2], map(int, items[1::2]), strict=True))


PARAS, CHARS, CELLS = _largest(PARA), _largest(CHAR), _largest(CELL)
CONTENT = PARAS | CHARS | CELLS | {"id": 0, "c": 0, "v": 0, "tr": 0, "esb": 0, "esbe": 0, "periph": 0}
MILESTONES = {"qt": 5, "ts": 0, "t": 0}


class MarkerError(ValueError):
    """kind: unknown, range or number."""

    def __init__(self, kind: str, marker: str):
        super().__init__(f"{kind} marker {marker!r}")
        self.kind = kind


@dataclass(frozen=True)
class Marker:
    base: str
    low: int | None = None
    high: int | None = None
    side: str | None = None


@functools.lru_cache(10_000)
def parse_marker(text: str, milestone: bool = False) -> Marker:
    """A marker's base and number; a missing number of a numbered marker is one."""
    m = re.fullmatch(r"([a-z]+?)(\d*)(?:-(?:(\d*)|([se])))?", text)
    known = MILESTONES if milestone else CONTENT
    if m is None or m[1] not in known:
        if text not in CONTENT:
            raise MarkerError("unknown", text)
        return Marker(text)
    base, number, second, side = m[1], m[2], m[3], m[4]
    if milestone != (side is not None) and not (milestone and side is None):
        raise MarkerError("unknown", text)
    top = known[base]
    if second is not None and (base not in CELLS or not second or not number):
        raise MarkerError("number", text)
    low = int(number) if number else 1 if top else None
    high = int(second) if second else low
    if number and (top == 0 or not 1 <= low <= top or not low <= high <= top):
        raise MarkerError("range", text)
    return Marker(base, low, high, side)


def marker_base(marker: Column) -> Column:
    return F.regexp_extract(marker, r"^([a-z]+)", 1)


def is_title(marker: Column) -> Column:
    return F.coalesce(marker_base(marker).isin(*TITLES), F.lit(False))


@functools.lru_cache(10_000)
def digits(text: str) -> int | None:
    """A small number in any decimal digits of three bytes at most each."""
    plain = unicodedata.normalize("NFKD", text)
    return int(plain) if plain.isascii() and plain.isdigit() and 1 <= int(plain) <= 255 else None


@functools.lru_cache(10_000)
def verse_range(text: str) -> tuple[int, int] | None:
    """`5` or `5-7`; letters around the numbers are dropped, open ends and falling ranges refused."""

    def bare(s: str) -> int | None:
        chars = [i for i, c in enumerate(s) if c.isnumeric()]
        return digits(s[chars[0] : chars[-1] + 1]) if chars else None

    a, dash, b = text.partition("-")
    first = bare(a)
    last = bare(b) if dash else first
    return (first, last) if first and last and first <= last else None


def range_text(first: Column, last: Column) -> Column:
    """`n` or `a-b`."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


SID = r"^([A-Z0-9]{3}) ?([0-9]+)(?::([0-9]+)(?:-([0-9]+))?)?$"


def parse_sid(text: str) -> tuple[str, int, int | None, int | None] | None:
    """`GEN 5` or `GEN 5:10-12` as id, chapter, first and last verse."""
    m = re.match(SID, text)
    if not m:
        return None
    first = int(m[3]) if m[3] else None
    return m[1], int(m[2]), first, int(m[4]) if m[4] else first


def sid_column(c: Column) -> Column:
    """parse_sid in the JVM: (book, chapter, v_first, v_last, shown), null for what is no id; shown is the id as format_sid writes it."""
    part = lambda k: F.regexp_extract(c, SID, k)
    number = lambda k: F.when(part(k) != "", part(k).cast("int"))
    chapter, first = number(2), number(3)
    last = F.coalesce(number(4), first)
    verses = F.when(first.isNull(), "").otherwise(F.concat(F.lit(":"), range_text(first, last)))
    return F.when(c.rlike(SID), F.struct(part(1).alias("book"), chapter.alias("chapter"), first.alias("v_first"), last.alias("v_last"), F.concat(part(1), F.lit(" "), chapter.cast("string"), verses).alias("shown")))


def format_sid(book: str, chapter: int, first: int | None = None, last: int | None = None) -> str:
    verses = "" if first is None else f":{first}" if first == last or last is None else f":{first}-{last}"
    return f"{book} {chapter}{verses}"


MACHINE = r"^[A-Z0-9]{3}(-[A-Z0-9]{3})? ?[a-z0-9\-:]*$"


def alpha_label(n: Column) -> Column:
    """1 is a, 26 z, 27 aa, as note callers are lettered; up to six letters."""
    out, rest = F.lit(""), n
    for _ in range(6):
        digit = F.pmod(rest - 1, F.lit(26)).cast("int")
        out = F.when(rest > 0, F.concat(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), digit + 1, F.lit(1)), out)).otherwise(out)
        rest = F.when(rest > 0, ((rest - 1 - digit) / 26).cast("long")).otherwise(F.lit(0))
    return out


#: Blocks of letters that are written from right to left.
RTL = r"\p{IsHebrew}\p{IsArabic}\p{IsSyriac}\p{IsThaana}\p{IsNko}"


def text_direction(text: Column) -> Column:
    """ltr or rtl by the first strong letter; null without one."""
    first = F.regexp_extract(text, r"(\p{L})", 1)
    return F.when(first == "", None).when(first.rlike(f"[{RTL}]"), "rtl").otherwise("ltr")
