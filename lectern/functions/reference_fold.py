"""The reference language in the JVM: what references.Parser makes of a text, as one fold over its parts.

What a part says by itself (a name, a chapter, verses, the source of each) comes from patterns; the fold carries the book and the chapter from part to part and
decides by cases. The catalog comes along as constants: names in buckets of a checksum, so that a look-up reads a few keys, and verse counts by place. The texts of
this form are ASCII without control characters other than blanks, for which the normal form is lower case without blanks; references.parse_column sends others
to the parser.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import Catalog
from .normalize import normalize

#: Texts of this form.
PLAIN = r"^[\x20-\x7E\t\n\x0B\f\r]*$"
BUCKETS = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class _Constants:
    """The catalog as constants of a plan."""

    def __init__(self, catalog: Catalog):
        names = {normalize(k)[0]: b.ord for k, b in reversed(list(catalog.by_key.items()))}
        buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        for name, book in names.items():
            buckets[zlib.crc32(name.encode()) % BUCKETS][name] = book
        self.names = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
        self.counts = F.from_json(F.lit(json.dumps([list(b.verse_counts) for b in catalog.books])), "array<array<int>>")
        self.shown = F.from_json(F.lit(json.dumps([b.display_name for b in catalog.books])), "array<string>")

    def book(self, name: Column) -> Column:
        return F.element_at(F.get(self.names, (F.crc32(name) % BUCKETS).cast("int")), name)

    def count(self, book: Column, chapter: Column) -> Column:
        """The verses of a chapter; null where there is none."""
        return F.get(F.get(self.counts, book), chapter - 1)


def _bare(c: Column) -> Column:
    return F.translate(c, " \t\n\x0b\f\r", "")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _number(c: Column) -> Column:
    """1 to 255; a leading plus is fine."""
    n = c.try_cast("int")
    return F.when(n.between(1, 255) & ~F.startswith(c, F.lit("-")), n)


#: A name is followed by a number or a colon; without one the whole part is read as a number.
NAMED = r"^([0-9]*[^0-9:]+)[0-9:]"


def _facts(raw: Column, known: _Constants) -> Column:
    """What a part says without those before it. Sources are cut out of raw where an error needs them."""

    def of(x: Column) -> Column:
        rest = F.substring(x["bare"], F.length(x["name"]) + 1, F.length(x["bare"]))
        return let(F.struct(F.instr(rest, ":").alias("at"), rest.alias("rest")), lambda y: verses(x, y, F.when(y["at"] > 0, F.substring(y["rest"], y["at"] + 1, F.length(y["rest"]))).otherwise(y["rest"])))

    def verses(x: Column, y: Column, s: Column) -> Column:
        return let(s, lambda s: let(F.instr(s, "-"), lambda dash: F.struct(
            x["raw"].alias("raw"), x["bare"].alias("bare"), (x["name"] != "").alias("named"), F.when(x["name"] != "", known.book(x["name"])).alias("book"),
            (y["at"] > 0).alias("colon"), F.when(y["at"] > 0, _number(F.substring(y["rest"], F.lit(1), y["at"] - 1))).alias("head_n"), F.when(y["at"] == 0, _number(y["rest"])).alias("rest_n"),
            (dash > 0).alias("dash"), F.when(dash > 0, F.substring(s, F.lit(1), dash - 1)).otherwise(s).alias("a"), F.when(dash > 0, F.substring(s, dash + 1, F.length(s))).otherwise("").alias("b"),
        )))

    bare = F.lower(_bare(raw))
    return let(F.struct(raw.alias("raw"), bare.alias("bare"), F.regexp_extract(bare, NAMED, 1).alias("name")), of)


def _source(x: Column, what: Column) -> Column:
    """The source of a piece of a part: raw, name, rest, head (before the colon), a and b (before and after the dash)."""
    rest = F.when(x["named"], F.regexp_extract(x["raw"], r"(?s)^[0-9\s]*[^0-9:]*(.*)$", 1)).otherwise(x["raw"])
    s = F.when(x["colon"], F.regexp_extract(rest, r"(?s)^[^:]*:(.*)$", 1)).otherwise(rest)
    cut = F.when(what == "name", F.regexp_extract(x["raw"], r"(?s)^([0-9\s]*[^0-9:]*)", 1)).when(what == "rest", rest).when(what == "head", F.substring_index(rest, ":", 1)).when(what == "a", F.substring_index(s, "-", 1)).when(what == "b", F.regexp_extract(s, r"(?s)^[^-]*-(.*)$", 1))
    return _trim(cut.otherwise(x["raw"]))


SAID = "struct<kind: string, chapter: int, first: int, last: int, shown: string>"


def _said(kind: str | None = None, chapter: Column | None = None, first: Column | None = None, last: Column | None = None, shown: str | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        (F.lit(kind) if kind else null.cast("string")).alias("kind"), *[(null if c is None else c).cast("int").alias(n) for n, c in (("chapter", chapter), ("first", first), ("last", last))], F.lit(shown).cast("string").alias("shown")
    ).cast(SAID)


def _verses(x: Column, chapter: Column, count: Column) -> Column:
    """The verses of a part in a chapter of so many; chapter and count may be null."""
    low = F.when(x["dash"] & (x["a"] == ""), 1).otherwise(_number(x["a"]))
    ends = let(low, lambda n: F.struct(n.alias("first"), F.when(~x["dash"], n).when(x["b"] == "", count).otherwise(_number(x["b"])).alias("last")))

    def of(e: Column) -> Column:
        first, last = e["first"], e["last"]
        return (
            F.when(count.isNull(), _said("out_of_bounds_chapter", chapter))
            .when(first.isNull(), _said("invalid_verse", shown="a"))
            .when(first > count, _said("out_of_bounds_verse", chapter, first))
            .when(last.isNull(), _said("invalid_verse", shown="b"))
            .when(last > count, _said("out_of_bounds_verse", chapter, last))
            .when(first > last, _said("out_of_order_verses", chapter, first, last))
            .otherwise(_said(None, chapter, first, last))
        )

    return let(ends, of)


def _within(x: Column, book: Column, carried: Column, known: _Constants) -> Column:
    """A part as a reference to a book, after a chapter (null: none)."""
    no_number = F.when(known.book(x["bare"]).isNotNull(), _said("missing_chapter")).otherwise(_said("unknown_book", shown="rest"))
    count = known.count(book, carried)
    whole = known.count(book, x["rest_n"])
    return (
        F.when(x["colon"] & x["head_n"].isNull(), _said("invalid_chapter", shown="head"))
        .when(x["colon"], let(known.count(book, x["head_n"]), lambda n: _verses(x, x["head_n"], n)))
        .when(carried.isNotNull() & count.isNull(), _said("out_of_bounds_chapter", carried))
        .when(carried.isNotNull(), let(let(count, lambda n: _verses(x, carried, n)), lambda v: F.when(v["kind"].isNull(), v).otherwise(no_number)))
        .when(x["rest_n"].isNull(), no_number)
        .when(whole.isNull(), _said("out_of_bounds_chapter", x["rest_n"]))
        .otherwise(_said(None, x["rest_n"], F.lit(1), whole))
    )


def _message(x: Column, said: Column, book: Column, known: _Constants) -> Column:
    """The texts of references.MESSAGES."""
    kind, shown = said["kind"], F.get(known.shown, book)
    quoted = lambda text: F.concat(F.lit(text), F.lit(' "'), _source(x, said["shown"]), F.lit('"'))
    number = lambda c: said[c].cast("string")
    return (
        F.when(kind == "missing_chapter", "No chapter specified")
        .when(kind == "invalid_chapter", quoted("Invalid chapter number"))
        .when(kind == "invalid_verse", quoted("Invalid verse number"))
        .when(kind == "unknown_book", quoted("Unknown book"))
        .when(kind == "out_of_bounds_chapter", F.concat(F.lit("Book "), shown, F.lit(" has no chapter "), number("chapter")))
        .when(kind == "out_of_bounds_verse", F.concat(shown, F.lit(" "), number("chapter"), F.lit(" has no verse "), number("first")))
        .when(kind == "out_of_order_verses", F.concat(F.lit("Verse "), number("first"), F.lit(" is after verse "), number("last")))
    )


def parse_plain(text: Column, catalog: Catalog, parts_type: str) -> Column:
    """The parts of a PLAIN text."""
    known = _Constants(catalog)
    raw = F.filter(F.split(text, "[;,]"), lambda p: _bare(p) != "")
    facts = F.transform(raw, lambda p: _facts(p, known))

    def step(state: Column, x: Column) -> Column:
        lost = x["named"] & x["book"].isNull()
        book = F.when(lost, 0).when(x["named"], x["book"]).otherwise(state["book"])
        chapter = F.when(x["named"] & ~lost, None).otherwise(state["chapter"]).cast("int")
        alone = ~x["named"] & state["book"].isNull()
        bare = F.when(known.book(x["bare"]).isNotNull(), _said("missing_chapter")).otherwise(_said("unknown_book", shown="raw"))

        def close(r: Column) -> Column:
            return let(F.when(lost, _said("unknown_book", shown="name")).otherwise(r), lambda said: closed(r, said))

        def closed(r: Column, said: Column) -> Column:
            kind = said["kind"]
            fine = kind.isNull()
            syntax = kind.isin("missing_chapter", "invalid_chapter", "invalid_verse") | (kind == "unknown_book") & ~(lost & r["kind"].isNull())
            part = F.struct(
                F.size(state["out"]).alias("part_no"), F.when(fine, book).cast("int").alias("book_ord"), F.when(fine, said["chapter"]).alias("chapter"), F.when(fine, said["first"]).alias("v_first"), F.when(fine, said["last"]).alias("v_last"),
                kind.alias("error_type"), F.when(~fine, _message(x, said, book, known)).alias("message"), F.when(fine, "").otherwise(_trim(x["raw"])).alias("source"), F.coalesce(syntax, F.lit(False)).alias("is_syntax"),
            )
            after = F.when(alone, state["chapter"]).when(x["colon"] & x["head_n"].isNotNull(), x["head_n"]).otherwise(chapter)
            return F.struct(F.when(lost, state["book"]).otherwise(book).cast("int").alias("book"), after.cast("int").alias("chapter"), F.concat(state["out"], F.array(part)).cast(parts_type).alias("out"))

        return let(F.when(alone, bare).otherwise(_within(x, book, chapter, known)), close)

    start = F.struct(F.lit(None).cast("int").alias("book"), F.lit(None).cast("int").alias("chapter"), F.array().cast(parts_type).alias("out"))
    return F.aggregate(facts, start, step, lambda s: s["out"])
