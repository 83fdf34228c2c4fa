"""The backslash-marker text format, read into the same trees as JSON.

Reading never stops: what is wrong becomes a diagnostic, and a default stands in for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..functions.markers import ALIGN, CELLS, NOTES, PARAS, MarkerError, digits, parse_marker, verse_range
from .usj import VERSION

TOKEN = re.compile(r"\\(\+?)([A-Za-z0-9]+(?:-[a-z0-9]+)?)(\*?)|\\\*")
ATTRIBUTE = re.compile(r'([\w-]+)\s*=\s*"([^"]*)"')
#: The attribute that stands without a name.
UNNAMED = {"w": "lemma", "rb": "gloss", "xt": "link-href", "ref": "loc", "fig": "alt"}
#: Characters that part a note.
NOTE_CHARS = frozenset("fr fq fqa fk fl fw fp fv ft fdc fm xo xop xk xq xt xta xot xnt xdc".split())
BOOK_CODE = re.compile(r"[A-Z0-9][A-Z][A-Z0-9]")


class NoteError(ValueError):
    """kind: length or not_a_note."""

    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.diagnostics: list[dict] = []
        self.root: list = []
        self.block: dict | None = None  # the open paragraph, or cell
        self.inline: list[dict] = []  # open characters and notes, the innermost last
        self.side: dict | None = None
        self.table: dict | None = None
        self.book, self.chapter = "", 0

    def say(self, severity: str, message: str) -> None:
        self.diagnostics.append({"severity": severity, "message": message, "position": self.at})

    def top(self) -> list:
        return self.side["content"] if self.side else self.root

    def word(self) -> str:
        """The next run of characters other than white space and backslashes, and one blank after it."""
        m = re.compile(r"[ \t\r\n]*([^\s\\]*)[ \t\r\n]?").match(self.text, self.at)
        self.at = m.end()
        return m[1]

    def line(self) -> str:
        m = re.compile(r"[^\\\n]*").match(self.text, self.at)
        self.at = m.end()
        return m[0].strip()

    def place(self) -> list:
        if self.inline:
            return self.inline[-1]["content"]
        if self.block is None:
            self.block = {"type": "para", "marker": "p", "content": []}
            self.top().append(self.block)
        return self.block["content"]

    def put_text(self, s: str) -> None:
        if not s or self.block is None and not self.inline and not s.strip():
            return
        parts = s.split("//")
        for i, part in enumerate(parts):
            where = self.place()
            if i:
                where.append({"type": "optbreak"})
            if part:
                if where and isinstance(where[-1], str):
                    where[-1] += part
                else:
                    where.append(part)

    def close_inline(self) -> None:
        if self.inline:
            self.say("warning", f"\\{self.inline[0]['marker']} is not closed")
        self.inline = []

    def start_block(self, node: dict) -> None:
        self.close_inline()
        self.table = None
        self.top().append(node)
        self.block = node

    def attributes(self, node: dict) -> None:
        """What follows a bar in the text of a character."""
        content = node["content"]
        if content and isinstance(content[-1], str) and "|" in content[-1]:
            content[-1], _, spec = content[-1].rpartition("|")
            named = ATTRIBUTE.findall(spec)
            node |= dict(named) if named else {UNNAMED.get(node["marker"], "default"): spec.strip()}
            if not content[-1]:
                content.pop()

    def marker(self, nested: str, name: str, end: str) -> None:
        if end:
            self.end(name)
        elif name == "id":
            code = self.word()
            if not BOOK_CODE.fullmatch(code):
                self.say("warning", f"book code {code!r}")
            self.book = code.upper() or "GEN"
            rest = self.line()
            self.start_block({"type": "book", "marker": "id", "code": self.book, "content": [rest] if rest else []})
            self.block = None
        elif name == "c":
            s = self.word()
            if digits(s) is None:
                self.say("error", f"chapter {s!r}")
                s = "1"
            self.chapter = digits(s)
            self.start_block({"type": "chapter", "marker": "c", "number": s, "sid": f"{self.book} {s}"})
            self.block = None
        elif name == "v":
            s = self.word()
            if verse_range(s) is None:
                self.say("error", f"verse {s!r}")
                s = "1"
            if any(x["type"] == "note" for x in self.inline):
                self.close_inline()
            self.inline = []
            self.place().append({"type": "verse", "marker": "v", "number": s, "sid": f"{self.book} {self.chapter or 1}:{s}"})
        elif name == "esb":
            self.start_block({"type": "sidebar", "marker": "esb", "content": []})
            self.side, self.block = self.block, None
        elif name == "esbe":
            self.close_inline()
            self.side = self.block = None
        elif name == "periph":
            alt = self.line()
            self.start_block({"type": "periph", "alt": alt.partition("|")[0], "content": [], **dict(ATTRIBUTE.findall(alt))})
            self.block = None
        elif name == "tr":
            self.close_inline()
            if self.table is None:
                self.table = {"type": "table", "content": []}
                self.top().append(self.table)
            row: dict = {"type": "table:row", "marker": "tr", "content": []}
            self.table["content"].append(row)
            self.block = None
            self.skip()
        elif name.rstrip("0123456789-") in CELLS:
            self.cell(name)
        elif name in NOTES:
            caller = self.word() or "+"
            if len(caller) != 1:
                self.say("warning", f"caller {caller!r}")
                caller = "+"
            note = {"type": "note", "marker": name, "caller": caller, "content": []}
            self.place().append(note)
            self.inline.append(note)
        elif name.endswith(("-s", "-e")):
            self.milestone(name)
        elif name.rstrip("0123456789") in PARAS and not nested and name not in ("cp",):
            self.paragraph(name)
        else:
            self.character(nested, name)

    def paragraph(self, name: str) -> None:
        try:
            parse_marker(name)
        except MarkerError as e:
            self.say("error", str(e))
            name = "p"
        self.start_block({"type": "para", "marker": name, "content": []})
        self.skip()

    def cell(self, name: str) -> None:
        if self.table is None or not self.table["content"]:
            self.say("error", f"\\{name} outside a row")
            self.marker("", "tr", "")
        try:
            parse_marker(name)
        except MarkerError as e:
            self.say("error", str(e))
            name = "tc1"
        self.close_inline()
        base = name.rstrip("0123456789-")
        cell = {"type": "table:cell", "marker": name, "align": ALIGN.get(base[2:], "start"), "content": []}
        self.table["content"][-1]["content"].append(cell)
        self.block = cell
        self.skip()

    def milestone(self, name: str) -> None:
        try:
            parse_marker(name, True)
        except MarkerError as e:
            self.say("error", str(e))
            name = "qt1-s"
        node = {"type": "ms", "marker": name}
        m = re.compile(r"([^\\]*)\\\*").match(self.text, self.at)
        if m:
            node |= dict(ATTRIBUTE.findall(m[1]))
            self.at = m.end()
        self.place().append(node)

    def character(self, nested: str, name: str) -> None:
        if name.startswith("z"):
            self.say("error", f"\\{name} is not of the standard")
        try:
            parse_marker(name)
        except MarkerError as e:
            self.say("error", str(e))
            name = "no"
        kind = {"fig": "figure", "ref": "ref"}.get(name, "char")
        if not nested and self.inline and self.inline[-1]["type"] == "char":
            # an unnested marker ends the character before it, but stands within the text of a note
            while self.inline and self.inline[-1]["type"] == "char" and not (self.inline[-1]["marker"] in NOTE_CHARS and name not in NOTE_CHARS):
                self.attributes(self.inline.pop())
        node: dict = {"type": kind, "marker": name, "content": []}
        self.place().append(node)
        self.inline.append(node)
        self.skip()

    def end(self, name: str) -> None:
        for k in range(len(self.inline) - 1, -1, -1):
            if self.inline[k]["marker"] == name:
                for node in self.inline[k:]:
                    if node["type"] != "note":
                        self.attributes(node)
                del self.inline[k:]
                return
        self.say("warning", f"\\{name}* closes nothing")

    def skip(self) -> None:
        """One blank belongs to the marker before it."""
        if self.at < len(self.text) and self.text[self.at] in " \t\r\n":
            self.at += 1

    def read(self) -> None:
        while self.at < len(self.text):
            m = TOKEN.search(self.text, self.at)
            if m is None:
                self.put_text(self.text[self.at :])
                break
            self.put_text(self.text[self.at : m.start()])
            self.at = m.end()
            if m[2]:
                self.marker(m[1], m[2], m[3])
        self.close_inline()


def tidy(node: dict) -> dict:
    """Paragraphs without content carry none, as in JSON; a character of note category moves to its note."""
    for child in node.get("content", []):
        if isinstance(child, dict):
            tidy(child)
    if node.get("type") in ("para", "figure", "ref", "book") and not node.get("content"):
        node.pop("content", None)
    if node.get("type") in ("note", "sidebar"):
        for child in list(node.get("content", [])):
            if isinstance(child, dict) and child.get("marker") == "cat":
                node["category"] = "".join(x for x in child["content"] if isinstance(x, str)).strip()
                node["content"].remove(child)
    return node


def read_usfm(text: str) -> tuple[dict, list[dict]]:
    """(tree, diagnostics)."""
    reader = _Reader(text)
    reader.read()
    return tidy({"type": "USJ", "version": VERSION, "content": reader.root}), reader.diagnostics


def read_note(text: str) -> dict:
    """The one note that a text is."""
    reader = _Reader(text)
    reader.read()
    found = [x for block in reader.root for x in (block.get("content", []) if block.get("marker") == "p" and block["type"] == "para" and not text.lstrip().startswith("\\p ") else [block])]
    if len(found) != 1:
        raise NoteError("length")
    if not isinstance(found[0], dict) or found[0]["type"] != "note":
        raise NoteError("not_a_note")
    return tidy(found[0])


def texts(node: object) -> Iterator[str]:
    if isinstance(node, str):
        yield node
    else:
        for child in node.get("content", []):  # type: ignore[union-attr]
            yield from texts(child)
