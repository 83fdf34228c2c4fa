"""The catalog of books: canonical order, names, aliases, and the verse counts of their chapters.

The catalog is a parameter of the engine. It is read from a Markdown table with the columns ord, variant, usfm_id, chapters,
verses, aliases, verse counts; a line of common aliases above it names the groups that aliases are products of.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The first ordinals after the Old Testament, the New Testament and the Apocrypha.
FIRST_NT, FIRST_AP, FIRST_SPECIAL = 39, 66, 98
ORDINALS = {"First": "1", "Second": "2", "Third": "3", "Fourth": "4", "Fifth": "5", "Sixth": "6"}


@dataclass(frozen=True)
class Book:
    ord: int
    variant: str
    usfm_id: str
    verse_counts: tuple[int, ...]
    aliases: tuple[str, ...] = field(default=(), compare=False)

    @property
    def category(self) -> str:
        return "OT" if self.ord < FIRST_NT else "NT" if self.ord < FIRST_AP else "AP" if self.ord < FIRST_SPECIAL else "special"

    @property
    def chapter_count(self) -> int:
        return len(self.verse_counts)

    def verse_count(self, chapter: int) -> int | None:
        return self.verse_counts[chapter - 1] if 1 <= chapter <= len(self.verse_counts) else None

    @property
    def display_name(self) -> str:
        """Numbered books of both Testaments show a digit and spaced words; others show their name as it is."""
        if self.variant == "SongOfSolomon":
            return "Song of Solomon"
        m = re.match("(First|Second|Third)([A-Z].*)", self.variant)
        return f"{ORDINALS[m[1]]} {m[2]}" if m and self.ord < FIRST_AP else self.variant


class Catalog:
    def __init__(self, books: list[Book]):
        self.books = sorted(books, key=lambda b: b.ord)
        self.by_key: dict[str, Book] = {}
        for b in self.books:
            for name in (b.variant, b.usfm_id, *b.aliases):
                self.by_key.setdefault(name.lower(), b)

    def __getitem__(self, ord_: int) -> Book:
        return self.books[ord_]

    def find(self, name: str) -> Book | None:
        """By variant, id or built-in alias, whatever the case."""
        return self.by_key.get(name.lower())

    def frame(self, spark: SparkSession) -> DataFrame:
        """dim_book: one row a book."""
        rows = [(b.ord, b.variant, b.usfm_id, b.display_name, b.category, b.chapter_count, list(b.verse_counts)) for b in self.books]
        return spark.createDataFrame(rows, "ord int, variant string, usfm_id string, display_name string, category string, chapter_count int, verse_counts array<int>")

    def alias_frame(self, spark: SparkSession) -> DataFrame:
        """dim_book_alias: lower-case alias, book, source."""
        return spark.createDataFrame([(k, b.ord, "built-in") for k, b in sorted(self.by_key.items())], "alias_key string, book_ord int, source string")


def expand_alias(spec: str, common: dict[str, list[str]]) -> list[str]:
    """`A×B` is every concatenation; a named group holds its own name first; `[x,y]` is a literal list; else the string itself."""
    groups = []
    for part in (p.strip() for p in spec.split("×")):
        if part.startswith("["):
            groups.append([x.strip() for x in part.strip("[]").split(",")])
        else:
            groups.append([part, *common.get(part, [])])
    return ["".join(x) for x in itertools.product(*groups)]


def read_catalog(text: str) -> Catalog:
    common: dict[str, list[str]] = {}
    for m in re.finditer(r"(\w+)=((?:\w+(?:,\w+)*)|\(none\))", text):
        if m[1][0].isupper() and m.start() < text.find("| ord |"):
            common.setdefault(m[1], [] if m[2] == "(none)" else m[2].split(","))
    books = []
    for line in text.split("\n"):
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        if len(cells) < 7 or not cells[0].isdigit() or not re.fullmatch("[A-Z0-9]{3}", cells[2]):
            continue
        spec, _, rest = cells[5].partition("(exclude:")
        excluded = {x.strip() for x in rest.rstrip(")").split(",") if x.strip()}
        names = [a for s in spec.split(";") if s.strip() not in ("", "–") for a in expand_alias(s.strip(), common)]
        if lost := excluded - set(names):
            raise ValueError(f"{cells[1]}: excluded aliases that nothing makes: {sorted(lost)}")
        counts = tuple(int(x) for x in cells[6].split()) if cells[6] != "–" else ()
        books.append(Book(int(cells[0]), cells[1], cells[2], counts, tuple(n for n in names if n not in excluded)))
    return Catalog(books)


@functools.lru_cache(maxsize=4)
def load(path: str | None = None) -> Catalog:
    """The catalog at path, at $CATALOG_PATH, or that of the package."""
    path = path or os.environ.get("CATALOG_PATH") or str(Path(__file__).with_name("catalog.md"))
    return read_catalog(Path(path).read_text(encoding="utf-8"))
