"""Documents as JSON trees, and their flat form: one row a node, in page order, with its path.

A tree comes from JSON or from the text format; both are flattened alike. Spark structs cannot recurse, so that trees are walked in
Python, a document at a time, and everything after is relational.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from ..functions.markers import TITLES, digits, parse_marker, verse_range

VERSION = "3.1"
NODE_FIELDS = (
    "path array<int>, seq int, last int, depth int, type string, marker string, marker_base string, text string, number_str string, number_first int, number_last int, "
    "alt_number string, pub_number string, sid string, code string, caller string, category string, align string, attrs map<string,string>, is_title boolean, is_index boolean, child_count int, in_para boolean"
)
#: Node types and the keys that each needs.
NEEDS = {
    "USJ": ("content",), "para": ("marker",), "char": ("marker", "content"), "book": ("code",), "chapter": ("number",), "verse": ("number",), "ms": ("marker",), "note": ("marker", "content", "caller"),
    "table": ("content",), "table:row": ("content",), "table:cell": ("marker",), "sidebar": ("content",), "figure": (), "ref": (), "periph": ("content",), "optbreak": (),
}
#: Keys of few nodes, with their columns; the other known ones are those of most nodes.
RARE_OF = {"altnumber": "alt_number", "pubnumber": "pub_number"} | {k: k for k in ("sid", "code", "caller", "category", "align")}
COMMON = frozenset("type version marker content number".split())
KNOWN = COMMON | RARE_OF.keys()
#: Where the index goes: into paragraphs and characters, not into notes, tables and the rest.
INDEXED = frozenset(("USJ", "para", "char"))


class DocumentError(ValueError):
    status = 400


def read_json(text: str) -> dict:
    """A document; unknown types, missing keys and unknown markers are errors."""
    try:
        tree = json.loads(text)
    except json.JSONDecodeError as e:
        raise DocumentError(str(e)) from e
    check(tree, True)
    return tree


def check(node: object, root: bool = False) -> None:
    if isinstance(node, str) and not root:
        return
    if not isinstance(node, dict) or node.get("type") not in NEEDS or root and node["type"] != "USJ":
        raise DocumentError("a document is a tree of known nodes under one USJ root")
    kind = node["type"]
    for key in NEEDS[kind]:
        if key not in node:
            raise DocumentError(f"{kind} without {key}")
    if kind in ("para", "char", "table:cell"):
        try:
            parse_marker(node["marker"])
        except ValueError as e:
            raise DocumentError(str(e)) from e
    if kind == "chapter" and digits(node["number"]) is None or kind == "verse" and verse_range(node["number"]) is None:
        raise DocumentError(f"{kind} number {node['number']!r}")
    if kind in ("book", "figure", "ref") and len(node.get("content", [])) > 1:
        raise DocumentError(f"{kind} with more than one text")
    for child in node.get("content", []):
        check(child)


#: Columns that are kept by row, and the place of a node, as nodes.with_coordinates tells it.
RARE = (*RARE_OF.values(), "attrs")
PLACE = ("chapter", "v_first", "v_last")
FIELDS = tuple(f.strip().split(" ")[0] for f in NODE_FIELDS.replace("map<string,string>", "map").split(","))


class Columns:
    """The rows of trees, column by column. seq counts the nodes of a tree in page order; last is the largest seq below a node."""

    def __init__(self) -> None:
        self.size = 0
        self.full: dict[str, list] = {name: [] for name in (*FIELDS, *PLACE) if name not in RARE}
        self.rare: dict[str, dict[int, object]] = {name: {} for name in RARE}

    def add(self, tree: dict) -> None:
        full, rare, start = self.full, self.rare, self.size
        paths, types, markers, bases, texts, spans = full["path"], full["type"], full["marker"], full["marker_base"], full["text"], full["number_str"]
        firsts, lasts, ends, titles, index, children, para = full["number_first"], full["number_last"], full["last"], full["is_title"], full["is_index"], full["child_count"], full["in_para"]
        chapters, v_firsts, v_lasts = (full[name] for name in PLACE)
        chapter: int | None = None
        verse: tuple[int | None, int | None] = (None, None)
        begun = False

        def walk(node: dict, path: list[int], indexed: bool, in_para: bool) -> None:
            nonlocal chapter, verse, begun
            at = len(types)
            kind, content, marker, number = node["type"], node.get("content", ()), node.get("marker"), node.get("number")
            base = marker.rstrip("0123456789") if marker else None
            title = kind == "para" and base in TITLES
            span: tuple[int | None, int | None] | None = (None, None)
            if kind == "verse":
                span = verse_range(number)
                verse = span if begun else verse
            elif kind == "chapter":
                span = (digits(number),) * 2
                chapter = chapter if span[0] is None else span[0]
                verse, begun = (None, None), True
            paths.append(path)
            types.append(kind)
            markers.append(marker)
            bases.append(base)
            texts.append(None)
            spans.append(number)
            firsts.append(span[0])
            lasts.append(span[1])
            ends.append(at)
            titles.append(title)
            index.append(indexed)
            children.append(len(content))
            para.append(in_para)
            chapters.append(chapter)
            v_firsts.append(verse[0])
            v_lasts.append(verse[1])
            for key, value in node.items():
                if key not in COMMON:
                    if key in RARE_OF:
                        if value is not None:
                            rare[RARE_OF[key]][at] = value
                    else:
                        rare["attrs"].setdefault(at, []).append((key, str(value)))
            below, inner = indexed and kind in INDEXED and not title, kind == "para"
            for i, child in enumerate(content):
                if not isinstance(child, str):
                    walk(child, [*path, i], below, inner)
                    continue
                paths.append([*path, i])
                types.append("text")
                markers.append(None)
                bases.append(None)
                texts.append(child)
                spans.append(None)
                firsts.append(None)
                lasts.append(None)
                ends.append(len(ends))
                titles.append(False)
                index.append(below)
                children.append(0)
                para.append(inner)
                chapters.append(chapter)
                v_firsts.append(verse[0])
                v_lasts.append(verse[1])
            ends[at] = len(types) - 1

        walk(tree, [], True, False)
        self.size = len(types)
        full["seq"].extend(range(self.size - start))
        full["depth"].extend(map(len, paths[start:]))
        if start:
            ends[start:] = [e - start for e in ends[start:]]

    def skip(self) -> None:
        """A row without a node."""
        for values in self.full.values():
            values.append(None)
        self.rare["attrs"][self.size] = None
        self.size += 1

    def column(self, name: str) -> list:
        if name in self.full:
            return self.full[name]
        out: list = [[] if name == "attrs" else None] * self.size
        for at, value in self.rare[name].items():
            out[at] = value
        return out


def books_in(node: dict) -> Iterator[dict]:
    """The book nodes of a tree, in page order."""
    if node["type"] == "book":
        yield node
    for child in node.get("content", ()):
        if not isinstance(child, str):
            yield from books_in(child)


def flatten(tree: dict) -> list[dict]:
    """The rows of a tree."""
    c = Columns()
    c.add(tree)
    rows = [dict(zip(FIELDS, values, strict=True)) for values in zip(*(c.column(name) for name in FIELDS), strict=True)]
    return [r | {"attrs": dict(r["attrs"])} for r in rows]


def nest(rows: Iterator[dict] | list[dict]) -> list:
    """Trees of rows in page order, by their paths; rows whose parent is not among them are roots."""
    out: list = []
    open_: list[tuple[tuple[int, ...], dict]] = []
    for r in rows:
        path = tuple(r["path"])
        node = r["text"] if r["type"] == "text" else to_node(r)
        while open_ and path[: len(open_[-1][0])] != open_[-1][0]:
            open_.pop()
        if open_:
            open_[-1][1].setdefault("content", []).append(node)
        else:
            out.append(node)
        if r["type"] != "text":
            open_.append((path, node))
    return out


def to_node(r: dict) -> dict:
    node = {"type": r["type"]}
    if r["type"] == "USJ":
        node["version"] = VERSION
    for key, column in (("marker", "marker"), ("number", "number_str"), ("altnumber", "alt_number"), ("pubnumber", "pub_number"), ("sid", "sid"), ("code", "code"), ("caller", "caller"), ("category", "category"), ("align", "align")):
        if r.get(column) is not None:
            node[key] = r[column]
    node |= dict(r.get("attrs") or {})
    if r["type"] in ("para", "char", "note", "table", "table:row", "table:cell", "sidebar", "periph", "USJ"):
        node["content"] = []
    return node


def insert_child(tree: dict, path: list[int], child: object) -> None:
    """Put a node before the place that path names."""
    node = tree
    for i in path[:-1]:
        node = node["content"][i]
    node["content"].insert(path[-1], child)
