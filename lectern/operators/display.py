"""What a client does with results: which nodes it shows, marked texts, labels of chapters, references as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import Catalog, load

KEYS = ("corpus_id", "book_ord")
HIDDEN = ("note", "chapter", "verse")


def shown(n: DataFrame) -> DataFrame:
    """The nodes that a list of results shows: no notes, marks and titles, nor what is below them."""
    hides = F.col("type").isin(*HIDDEN) | F.coalesce("is_title", F.lit(False))
    sofar = Window.partitionBy(*KEYS).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    # a node is hidden while a hiding one that came before it, or itself, reaches to it
    return n.withColumn("reach", F.max(F.when(hides, F.col("last"))).over(sofar)).where("reach is null or reach < seq").drop("reach")


def pieces_column(text: Column, places: Column) -> Column:
    """A text in pieces (text, marked) at places (start, end) that are in order and do not overlap; empty pieces are left out."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,marked:boolean>>").alias("out"))

    def piece(a: Column, b: Column, marked: bool) -> Column:
        return F.struct(F.substr(text, a + 1, b - a).alias("text"), F.lit(marked).alias("marked"))

    def add(acc: Column, p: Column) -> Column:
        out = F.concat(acc["out"], F.array(piece(acc["at"], p["start"].cast("int"), False), piece(p["start"].cast("int"), p["end"].cast("int"), True)))
        return F.struct(p["end"].cast("int").alias("at"), out.alias("out"))

    cut = F.aggregate(places, empty, add, lambda acc: F.concat(acc["out"], F.array(piece(acc["at"], F.length(text), False))))
    return F.filter(cut, lambda p: p["text"] != "")


def marked(content: list, highlights: list[dict]) -> list[tuple[tuple[int, ...], list[tuple[str, bool]]]]:
    """(path, pieces) of each text of a content; highlights are {start, end} of {path, ch} and may reach over several texts."""
    spans = [((tuple(h["start"]["path"]), h["start"]["ch"]), (tuple(h["end"]["path"]), h["end"]["ch"])) for h in highlights]
    out: list[tuple[tuple[int, ...], list[tuple[str, bool]]]] = []

    def cut(text: str, path: tuple[int, ...]) -> list[tuple[str, bool]]:
        edges = {0, len(text)}
        inside = []
        for (p0, c0), (p1, c1) in spans:
            if p0 <= path <= p1:
                a, b = c0 if p0 == path else 0, c1 if p1 == path else len(text)
                inside.append((a, b))
                edges |= {a, b}
        marks = sorted(e for e in edges if 0 <= e <= len(text))
        return [(text[a:b], any(x <= a and b <= y for x, y in inside)) for a, b in zip(marks, marks[1:])] or [(text, False)]

    def walk(nodes: list, path: tuple[int, ...]) -> None:
        for i, node in enumerate(nodes):
            if isinstance(node, str):
                out.append(((*path, i), cut(node, (*path, i))))
            else:
                walk(node.get("content", []), (*path, i))

    walk(content, ())
    return out


def is_label(node: object) -> bool:
    return isinstance(node, dict) and node["type"] == "para" and node.get("marker") == "cl"


def with_label(content: list, book_name: str) -> list:
    """A passage that starts a chapter, with the chapter's label in front.

    The chapter's own label, after its mark, takes the place of the book's common one or goes to the front; without it the common label gets the number;
    without either, the name of the book and the number are the label. A passage without a chapter mark stays.
    """
    at = next((i for i, x in enumerate(content) if isinstance(x, dict) and x["type"] == "chapter"), None)
    if at is None:
        return content
    number = content[at].get("pubnumber") or content[at]["number"]
    common = next((i for i in range(at) if is_label(content[i])), None)
    own = next((i for i in range(at + 1, len(content)) if is_label(content[i])), None)
    if own is not None:
        rest = content[:own] + content[own + 1 :]
        return [*rest[:common], content[own], *rest[common + 1 :]] if common is not None else [content[own], *rest]
    if common is not None:
        label = content[common] | {"content": [*content[common].get("content", []), f" {number}"]}
        return [*content[:common], label, *content[common + 1 :]]
    return [{"type": "para", "marker": "cl", "content": [f"{book_name} {number}"]}, *content]


def label_of(content: list, book_name: str) -> str:
    """The label of a chapter's passage as text: the name of the book, or the text of a label, and the numbers of the chapters after it."""
    label = book_name
    for x in content:
        if is_label(x):
            label = str((x.get("content") or [""])[0])
        elif isinstance(x, dict) and x["type"] == "chapter":
            label += f" {x.get('pubnumber') or x['number']}"
    return label


def reference_text(name: Column, chapter: Column, first: Column, last: Column) -> Column:
    """`Name C`, `Name C:V` or `Name C:V-W`; without verses the whole chapter."""
    verses = F.when(first.isNull(), "").when(last > first, F.concat(F.lit(":"), first, F.lit("-"), last)).otherwise(F.concat(F.lit(":"), first))
    return F.concat(name, F.lit(" "), chapter, verses)


def covers_chapter(book: int, chapter: int, first: int, last: int, catalog: Catalog | None = None) -> bool:
    """Whether a range of verses is its whole chapter."""
    return first == 1 and last == (catalog or load())[book].verse_count(chapter)
