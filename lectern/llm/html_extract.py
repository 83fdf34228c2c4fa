"""Main text of web pages by a tree-structured graphical model.

A page becomes its DOM tree. Every element and text node has a hidden state, content or not. Node potentials come from what is
seen of a node (its tag, the words of its class, id and role, the length of a text and whether a link holds it); edge
potentials join the states of parent and child, by the child's tag. Sum-product message passing, upward and then downward, gives
the exact marginal of every node; texts whose marginal exceeds one half are content. The potentials are smoothed counts over
labelled pages (training_pages), whose labels are known by construction: parts of usual names, and wrappers of any depth with no name or
one never seen, inside and outside of the article. A name counts by the share of its words that are known ("notice" says more than
"notice-board-history"), and little if less than half of them are (PARTIAL). Where the texts above one half are fewer than LEAST_TEXT characters, but an article or main part, or the page
outside links, has a text of that length, the texts that come next to the largest marginal there are taken (NEAR; ties all), so that an unusual page is not lost.

Blocks are what block elements part; white space inside a block becomes one blank, a line break too; blocks are joined by one
line feed. Nothing is capped. Scripts, styles, forms' controls, drawings, comments of the markup and the head hold no text of a page; formulas do.

Defined results: null html is empty, and its text is empty; so is that of a page without text. Rows that repeat are read each. Broken markup is read as
browsers do in the usual cases: implied and missing end tags, unknown end tags, unclosed and short comments; a drawing, list of choices or template that
never ends is taken as empty, so that what follows stays. An empty table gives no rows; a page of any length is one tree in memory; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship

#: Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
#: Elements whose text is not shown as text, those of them that markup after an open one ends, and those that may hold '/>'.
HUSHED = RAW | frozenset("noscript template svg select option optgroup datalist".split())
ENDED = frozenset("svg math select datalist noscript template".split())
FOREIGN = frozenset("svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption legend optgroup".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCES = frozenset("table ul ol dl article section main div body html td th aside nav footer header form".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/]|$)""", re.IGNORECASE)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ENDS: dict[str, re.Pattern] = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW | ENDED}
COMMENT_END = re.compile(r"--!?>")
#: A slash before '>' that is not the end of an attribute's value.
CLOSED = re.compile(r"""(?:^|[\s"'])/$""")


#: Sibling texts are alike, so that their evidence counts in part; names are rare and decide. A name counts from NAME_LEAST nodes of training pages.
NAME_WEIGHT, PLAIN_WEIGHT, NAME_LEAST = 2.0, 0.5, 12
#: Where nothing exceeds one half: the share of the largest marginal, in odds, that a text must have, and the characters of a text that make a page worth it.
NEAR, LEAST_TEXT = 0.2, 40
NAMES_KEPT = 10_000
#: What a name can say at most, in log odds, of which less than half of the words are known: "ad-free-reading" is no advert.
PARTIAL = 1.0


class Dom:
    """Nodes in page order: parent, tag (empty for a text), names (the words of each class, id and role), text."""

    def __init__(self):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["html"]
        self.names: list[tuple[tuple[str, ...], ...]] = [()]
        self.text: list[str] = [""]

    def add(self, parent: int, tag: str, names: tuple[tuple[str, ...], ...] = (), text: str = "") -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        return len(self.parent) - 1


def names_of(attributes: str) -> tuple[tuple[str, ...], ...]:
    if not attributes.strip(" /\n\t"):
        return ()
    out: list[tuple[str, ...]] = []
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), entities.unescape((m[2] or "").strip("\"'"))
        if key in ("class", "id", "role"):
            out += (words for name in value.split() if (words := tuple(w.lower() for w in NAME.findall(name))))
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            out.append(("hidden",))
    return tuple(dict.fromkeys(out))


def parse(page: str) -> Dom:
    dom, at, n = Dom(), 0, len(page)
    stack, hushed = [0], [False]  # the open elements, and whether their text is not shown
    no_end: set[str] = set()  # tags without an end tag in the rest of the page
    next_end: dict[str, int] = {}

    def tag_at(k: int) -> str:
        return dom.tag[stack[k]]

    def cut(k: int) -> None:
        del stack[k:], hushed[k:]

    def close_to(tags, fences) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if tag_at(k) in tags:
                cut(k)
                return
            if tag_at(k) in fences:
                return

    def add_text(s: str) -> None:
        if hushed[-1]:
            return
        if s.strip():
            dom.add(stack[-1], "", (), entities.unescape(s) if "&" in s else s)
        elif s and dom.tag[-1] == "":  # a blank between two texts counts
            dom.add(stack[-1], "", (), " ")
        elif s:
            dom.add(stack[-1], " ", (), " ")

    def has_end(tag: str) -> bool:
        """Whether an end tag follows; each part of the page is searched once for a tag."""
        if tag not in no_end and next_end.get(tag, -1) < at:
            m = ENDS[tag].search(page, at)
            if m:
                next_end[tag] = m.start()
            else:
                no_end.add(tag)
        return tag not in no_end

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add_text(page[at:])
            break
        if page.startswith("<!--", lt):
            add_text(page[at:lt])
            if page.startswith(("<!-->", "<!--->"), lt):
                at = page.index(">", lt) + 1
                continue
            end = COMMENT_END.search(page, lt + 4)
            at = n if end is None else end.end()
            continue
        if page.startswith(("<!", "<?"), lt):
            add_text(page[at:lt])
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(page, lt)
        if not m:
            after = page.find("<", lt + 1)
            add_text(page[at : n if after < 0 else after])
            at = n if after < 0 else after
            continue
        add_text(page[at:lt])
        at = m.end()
        closing, tag, attributes = m[1] or m[4] or "", (m[2] or m[5]).lower(), m[3] or m[6] or ""
        if closing:
            if tag in BLOCKS:
                close_to({tag}, {"body", "html"} if tag not in ("li", "td", "th", "tr", "p") else {"table", "article", "section", "aside", "body"} - {tag})
            else:
                close_to({tag}, BLOCKS)
            continue
        if tag in ("html", "body"):
            names = names_of(attributes)
            if tag == "body" and not any(dom.tag[k] == "body" for k in stack):
                cut(1)
                stack.append(dom.add(0, "body", names))
                hushed.append(False)
            continue
        if tag in BLOCKS and hushed[-1]:
            close_to(("svg", "select", "datalist"), BLOCKS)  # a block ends a drawing or a list of choices
        if tag in CLOSES_P:
            close_to({"p"}, {"table", "td", "th", "button", "body"})
        if tag in SIBLINGS:
            close_to(SIBLINGS[tag], FENCES - {"td", "th"})
        if tag in ("option", "optgroup"):
            close_to(("option",), ("select", "datalist"))
        node = dom.add(stack[-1], tag, names_of(attributes))
        if tag in RAW:
            end = ENDS[tag].search(page, at)
            if end is None:
                at = n
            else:
                close = page.find(">", end.end())
                at = n if close < 0 else close + 1
        elif tag not in VOID and not CLOSED.search(attributes) and not (tag in FOREIGN and attributes.endswith("/")) and (tag not in ENDED or has_end(tag)):
            stack.append(node)
            hushed.append(hushed[-1] or tag in HUSHED)
    return dom


def seen(dom: Dom, i: int, linked: bool) -> str:
    """What is seen of a node beside its names: the tag, or the length of a text and whether a link holds it."""
    tag = dom.tag[i]
    if tag in ("", " "):
        size = len(dom.text[i].strip())
        return f"text:{min(4, max(2, size.bit_length() // 2))}:{'link' if linked else 'plain'}"
    return f"tag:{tag}"


class Model:
    """Log potentials of nodes and edges, from counts over labelled trees."""

    def __init__(self):
        self.node = [Counter(), Counter()]
        self.edge: Counter = Counter()
        self.known: dict[tuple, float] = {}

    def learn(self, dom: Dom, labels: list[int]) -> None:
        linked = links(dom)
        for i, y in enumerate(labels):
            self.node[y][seen(dom, i, linked[i])] += 1
            for name in dom.names[i]:
                for w in name:
                    self.node[y][f"name:{w}"] += 1 / len(name)
            if i:
                kind = dom.tag[i] or "text"
                for key in (kind, "any"):
                    self.edge[key, labels[dom.parent[i]], y] += 1

    def ready(self) -> Model:
        """Tables for message passing; what was never seen is neutral."""
        total = [sum(c.values()) + 1.0 for c in self.node]
        self.lean: dict[str, float] = {}
        for f in {*self.node[0], *self.node[1]}:
            if f.startswith("name:") and self.node[0][f] + self.node[1][f] < NAME_LEAST:
                continue
            p = [(self.node[y][f] + 0.5) / total[y] for y in (0, 1)]
            self.lean[f] = math.log(p[1] / p[0]) * (NAME_WEIGHT if f.startswith("name:") else PLAIN_WEIGHT)
        self.step: dict[str, tuple[float, float, float, float]] = {}
        for key in {k for k, _, _ in self.edge}:
            row = []
            for parent in (0, 1):
                base = [self.edge["any", parent, y] + 1.0 for y in (0, 1)]
                prior = [4 * b / sum(base) for b in base]
                own = [self.edge[key, parent, y] + prior[y] for y in (0, 1)]
                row += [own[0] / sum(own), own[1] / sum(own)]
            self.step[key] = tuple(row)
        return self

    def leaning(self, dom: Dom, i: int, linked: bool) -> float:
        """The log odds of content that a node itself gives."""
        tag = dom.tag[i]
        if tag in ("", " "):
            return self.of_seen(("", min(4, max(2, len(dom.text[i].strip()).bit_length() // 2)), linked))
        names = dom.names[i]
        return self.of_seen((tag, 0, False)) + (self.of_names(names) if names else 0.0)

    def of_seen(self, what: tuple[str, int, bool]) -> float:
        if what not in self.known:
            tag, size, linked = what
            self.known[what] = self.lean.get(f"tag:{tag}" if tag else f"text:{size}:{'link' if linked else 'plain'}", 0.0)
        return self.known[what]

    def of_names(self, names: tuple[tuple[str, ...], ...]) -> float:
        """Names are few in kind, so that what they say is kept, for NAMES_KEPT of them."""
        if names not in self.known:
            total = 0.0
            for name in names:
                known = [x for w in name if (x := self.lean.get(f"name:{w}")) is not None]
                said = sum(known) * len(known) / len(name)
                total += said if 2 * len(known) >= len(name) else max(-PARTIAL, min(PARTIAL, said))
            if len(self.known) >= NAMES_KEPT:
                self.known.clear()
            self.known[names] = total
        return self.known[names]

    def marginals(self, dom: Dom) -> list[float]:
        """Probability of content for every node, by messages up and down the tree."""
        n = len(dom.parent)
        linked = links(dom)
        step, usual = self.step, self.step["any"]
        # belief of a node from itself and its subtree, as odds of content in logs
        own = [self.leaning(dom, i, linked[i]) for i in range(n)]
        up = [0.0] * n
        edges = [usual] * n
        for i in range(n - 1, 0, -1):
            p00, p01, p10, p11 = edges[i] = step.get(dom.tag[i] or "text", usual)
            odds = math.exp(max(-60.0, min(60.0, own[i])))
            up[i] = math.log((p10 + p11 * odds) / (p00 + p01 * odds))
            own[dom.parent[i]] += up[i]
        full = own[:]
        full[0] = own[0] + math.log(1e-3)  # the root itself is not content
        for i in range(1, n):
            p00, p01, p10, p11 = edges[i]
            above = math.exp(max(-60.0, min(60.0, full[dom.parent[i]] - up[i])))
            full[i] = own[i] + math.log((p01 + p11 * above) / (p00 + p10 * above))
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, x)))) for x in full]


def links(dom: Dom) -> list[bool]:
    out = [False] * len(dom.parent)
    for i in range(1, len(out)):
        out[i] = out[dom.parent[i]] or dom.tag[i] == "a"
    return out


def assemble(dom: Dom, content: list[bool]) -> str:
    """The content texts by blocks, in page order."""
    block = [0] * len(dom.parent)
    for i in range(1, len(block)):
        block[i] = i if dom.tag[i] in BLOCKS else block[dom.parent[i]]
    out: list[list[str]] = []
    last, reach = -1, {}
    ends = subtree_ends(dom)
    for i in range(1, len(block)):
        if dom.tag[i] in BLOCKS:
            last = -1  # a block starts
        elif dom.tag[i] == "br":
            if last == block[i]:
                out[-1].append(" ")
        elif dom.tag[i] in ("", " "):
            if last != block[i] or reach.get("end", 0) < i:
                if dom.tag[i] == " " or not content[i]:
                    if last != block[i]:
                        continue
                if last != block[i]:
                    out.append([])
                    last = block[i]
            reach["end"] = ends[block[i]]
            if content[i] or dom.tag[i] == " ":
                out[-1].append(dom.text[i])
    lines = (" ".join("".join(parts).split()) for parts in out)
    return "\n".join(s for s in lines if s)


def subtree_ends(dom: Dom) -> list[int]:
    """The last node below each node."""
    ends = list(range(len(dom.parent)))
    for i in range(len(ends) - 1, 0, -1):
        p = dom.parent[i]
        ends[p] = max(ends[p], ends[i])
    return ends


def extract_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    dom = parse(page)
    p = model.marginals(dom)
    return assemble(dom, chosen(dom, p)) if any(map(str.strip, dom.text)) else ""


def chosen(dom: Dom, p: list[float]) -> list[bool]:
    """The nodes above one half; where their texts are less than an article's, also those that come next.

    If texts of an article or main part are long enough, those of that part come next, links or not; else those outside links of the whole page,
    if none of them is above one half.
    """
    out = [x > 0.5 for x in p]
    linked, root = links(dom), [False] * len(p)
    for i in range(1, len(p)):
        root[i] = root[dom.parent[i]] or dom.tag[i] in ("article", "main")
    sizes = [len(t.strip()) if tag == "" else 0 for tag, t in zip(dom.tag, dom.text, strict=True)]
    if sum(n for n, y in zip(sizes, out, strict=True) if y) >= LEAST_TEXT:
        return out
    inside = [i for i, n in enumerate(sizes) if root[i] and n and not out[i]]
    if not any(sizes[i] >= LEAST_TEXT for i in inside):
        inside = [i for i, n in enumerate(sizes) if n and not linked[i]]
        if any(out[i] for i in inside) or not any(sizes[i] >= LEAST_TEXT for i in inside):
            return out
    odds = NEAR * max(p[i] / (1 - p[i]) for i in inside)
    for i in inside:
        out[i] = out[i] or p[i] > odds / (1 + odds)
    return out


# Labelled pages -------------------------------------------------------------------------------------------------------

#: How pages name their parts: main text, and what is not.
CONTENT_ROOTS = ("article", "main", "div:content", "div:article body", "div:post", "div:entry content", "section:story", "div#main", "section:article", "div:text", "div:main content", "div:post body")
MENUS = ("nav", "div:nav", "div:menu", "ul:menu", "div:navigation", "nav:navbar", "div:breadcrumb", "ul:breadcrumbs", "div:topbar", "nav:pagination", "div:pager", "div:toc")
HEADERS = ("header", "div:header", "div:masthead", "header:site header", "div#header", "div:banner", "header:page header", "div:logo")
FOOTERS = ("footer", "div:footer", "div#footer", "footer:site footer", "div:copyright", "div:legal", "div:bottom", "div:colophon")
SIDEBARS = ("aside", "div:sidebar", "aside:related", "div:related", "div#sidebar", "div:widget", "section:recommended", "div:trending", "div:popular", "aside:sidebar", "div:author bio", "div:tags", "div:more links")
NOTICES = ("div:cookie notice", "div:notice", "div:consent", "div:cookie banner", "div:gdpr", "div:alert", "section:notice", "div:popup", "div:modal", "div:privacy notice", "p:notice", "div:paywall", "div:disclaimer", "div:hidden", "div:overlay", "p:cookie")
ADVERTS = ("div:ad", "div:ads", "div:advert", "div:advertisement", "div:sponsored", "div:promo", "ins:adsbygoogle", "div:banner ad", "aside:ad", "div:sponsor", "section:promo", "p:ad", "div:promotion", "span:ad")
FORMS = ("form", "form:search", "form:newsletter", "div:newsletter", "form:login", "div:subscribe", "form:comment form", "div:signup", "div:search")
COMMENTS = ("div:comments", "section:comments", "div#comments", "ol:commentlist", "div:comment list", "ul:comments", "div:disqus thread", "section:responses", "div:replies", "div:discussion", "div:reviews", "article:comment")
#: The role that marks the root of the main text in training pages; it is taken away before anything is learned.
ROOT_MARK = "rootmark"
SHARES = ("div:share", "div:social", "ul:share buttons", "div:toolbar", "div:meta share")
WORDS = "river stone market quiet early seven paper window summer ledger copper garden letter engine harbour winter silver".split()


def training_pages(n: int = 2400, seed: int = 11) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """(html, [(marker, label)]) of made-up pages whose parts are known. Each text holds one marker word."""
    r = random.Random(seed)
    for _ in range(n):
        yield _Page(r).build()


class _Page:
    def __init__(self, r: random.Random):
        self.r, self.marks = r, []

    def unknown(self) -> str:
        """An attribute with a name that is not of the lists, or one word of them among others, or nothing."""
        r = self.r
        if r.random() < 0.4:
            return ""
        part = lambda: "".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
        words = [part() for _ in range(r.randint(1, 3))]
        if r.random() < 0.05:
            words = [*r.choice(NOTICES + ADVERTS + SIDEBARS + FOOTERS).split(":")[-1].split()[:1], part(), part()]
        return f' class="{r.choice(["-", "_", "__"]).join(words)}"' if r.random() < 0.9 else f' id="{words[0]}"'

    def wrapped(self, inner: str, p: float) -> str:
        """inner in wrappers without a known name, to any depth."""
        while self.r.random() < p:
            tag = self.r.choice(["div", "div", "div", "section"])
            inner = f"<{tag}{self.unknown()}>{inner}</{tag}>"
        return inner

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(WORDS) for _ in range(self.r.randint(low, high))).capitalize()

    def text(self, low: int, high: int, label: int) -> str:
        mark = f"m{len(self.marks)}x"
        self.marks.append((mark, label))
        return f"{mark} {self.words(low, high)}"

    def open(self, spec: str) -> tuple[str, str]:
        tag, sign, names = (spec.split(":")[0], ":", spec.split(":")[1]) if ":" in spec else (spec.split("#")[0], "#", spec.split("#")[1]) if "#" in spec else (spec, "", "")
        glue = self.r.choice([" ", "-", "_"])
        attribute = f' class="{names.replace(" ", glue)}"' if sign == ":" else f' id="{names.replace(" ", "-")}"' if sign else ""
        return f"<{tag}{attribute}>", f"</{tag}>"

    def links(self, k: int) -> str:
        items = "".join(f'<li><a href="/x">{self.text(0, 2, 0)}</a></li>' for _ in range(k))
        return f"<ul>{items}</ul>" if self.r.random() < 0.7 else "".join(f'<a href="/x">{self.text(0, 2, 0)}</a> ' for _ in range(k))

    def other(self, specs: tuple[str, ...], kind: str) -> str:
        spec = self.r.choice(specs)
        start, end = self.open(spec)
        if kind in ("menu", "share"):
            inner = self.links(self.r.randint(2, 6))
        elif kind == "side":
            inner = (f"<h3>{self.text(0, 3, 0)}</h3>" if self.r.random() < 0.6 else "") + (self.links(4) if self.r.random() < 0.6 else f"<p>{self.text(4, 30, 0)}</p>")
        elif kind == "header":
            inner = (f"<h1>{self.text(0, 3, 0)}</h1>" if self.r.random() < 0.3 else f"<span>{self.text(0, 4, 0)}</span>") + (self.links(3) if self.r.random() < 0.5 else f"<p>{self.text(1, 6, 0)}</p>")
        elif kind == "form":
            inner = f"<label>{self.text(0, 4, 0)}</label><input name=q><button>{self.text(0, 2, 0)}</button>" + (f"<p>{self.text(3, 18, 0)}</p>" if self.r.random() < 0.4 else "")
        elif kind == "comments":
            one = self.r.choice(["div class=comment", "li", "p", "li class=comment", "article class=comment"])
            inner = (f"<h3>{self.text(0, 3, 0)}</h3>" if self.r.random() < 0.7 else "") + "".join(f"<{one}>{self.text(4, 40, 0) if one == 'p' or self.r.random() < 0.4 else f'<p>{self.text(4, 40, 0)}</p>'}</{one.split()[0]}>" for _ in range(self.r.randint(1, 4)))
        elif spec.startswith(("p", "span")) or self.r.random() < 0.5:
            inner = self.text(2, 25, 0)
        else:
            inner = f"<p>{self.text(2, 25, 0)}</p>" + (f'<a href="/x">{self.text(0, 2, 0)}</a>' if self.r.random() < 0.4 else "")
        return self.wrapped(start + inner + end, 0.15)

    def block(self, depth: int = 0) -> str:
        r = self.r.random()
        if depth < 3 and r < 0.1:
            return self.wrapped("".join(self.block(depth + 1) for _ in range(self.r.randint(1, 3))), 0.8)
        if r < 0.14:  # loose text, and lines of it
            lines = "<br>".join(self.text(3, 40, 1) for _ in range(self.r.choice([1, 1, 2, 4])))
            return f"<div{self.unknown()}>{lines}</div>" if self.r.random() < 0.7 else f"{lines} "
        if r < 0.16:
            return f"<div{self.unknown()}>" + "".join(f"<figure><img src=a.png><figcaption>{self.text(1, 10, 1)}</figcaption></figure>" for _ in range(3)) + "</div>"
        if r < 0.18:
            return "<dl>" + "".join(f"<dt>{self.text(0, 3, 1)}</dt><dd>{self.text(2, 20, 1)}</dd>" for _ in range(3)) + "</dl>"
        if r < 0.2:
            return f"<p{self.unknown()}><a href=/x>{self.text(1, 6, 1)}</a></p>"
        r = self.r.random()
        inline = lambda: self.r.choice(["b", "i", "em", "strong", "a href=/x", "span", "code"])
        if r < 0.68:
            body = self.text(1, 60, 1)
            if self.r.random() < 0.3:
                tag = inline()
                body += f" <{tag}>{self.text(0, 3, 1)}</{tag.split()[0]}> {self.text(1, 20, 1)}"
            return f"<p{self.unknown() if self.r.random() < 0.2 else ''}>{body}" + ("</p>" if self.r.random() < 0.9 else "")
        if r < 0.78:
            return f"<h{self.r.randint(2, 4)}>{self.text(1, 8, 1)}</h2>"
        if r < 0.86:
            tag = self.r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.text(1, 12, 1)}</li>" for _ in range(self.r.randint(2, 5))) + f"</{tag}>"
        if r < 0.9:
            return f"<blockquote><p>{self.text(4, 30, 1)}</p></blockquote>"
        if r < 0.93:
            return f"<pre>{self.text(3, 20, 1)}</pre>"
        if r < 0.96:
            return "<table>" + "".join(f"<tr><td>{self.text(0, 4, 1)}</td><td>{self.text(0, 4, 1)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<figure><img src=a.png><figcaption>{self.text(2, 10, 1)}</figcaption></figure>"

    def build(self) -> tuple[str, list[tuple[str, int]]]:
        r = self.r
        some = lambda p, specs, kind: self.other(specs, kind) if r.random() < p else ""
        head = some(0.6, HEADERS, "header") + some(0.8, MENUS, "menu") + some(0.4, NOTICES, "notice") + some(0.5, ADVERTS, "ad")
        start, end = self.open(r.choice(CONTENT_ROOTS[:1] * 8 + CONTENT_ROOTS))
        if r.random() < 0.3:  # a root that says nothing
            tag = r.choice(["div", "div", "section", "main"])
            start, end = f"<{tag}{self.unknown()}>", f"</{tag}>"
        bare = r.random() < 0.12  # the body itself is the root
        start, end = ("", "") if bare else (start.replace(">", f' role="{ROOT_MARK}">'), end)
        title = f"<h1>{self.text(1, 8, 1)}</h1>"
        body = f"<header>{title}</header>" if r.random() < 0.15 else title if r.random() < 0.9 else ""
        for _ in range(r.randint(2, 10)):
            body += self.block()
            body += some(0.06, ADVERTS, "ad") + some(0.04, SIDEBARS, "side") + some(0.03, SHARES, "share") + some(0.02, FORMS, "form") + some(0.03, NOTICES, "notice")
        body += some(0.1, COMMENTS, "comments") + some(0.05, MENUS, "menu") + some(0.05, FOOTERS, "footer")
        body = self.wrapped(body, 0.25)
        tail = some(0.3, SHARES, "share") + some(0.45, COMMENTS, "comments") + some(0.4, SIDEBARS, "side") + some(0.4, FORMS, "form") + some(0.3, ADVERTS, "ad") + some(0.9, FOOTERS, "footer") + some(0.3, NOTICES, "notice")
        main = start + body + end
        if bare and r.random() < 0.5:  # and there is little else
            head, tail = "", ""
        if bare:
            return f'<!DOCTYPE html><html><head><title>t</title></head><body role="{ROOT_MARK}">{head}{main}{tail}</body></html>', self.marks
        main = self.wrapped(main, 0.15)
        main = f"<div{r.choice([' class=wrapper', self.unknown()])}>{head}{main}{tail}</div>" if r.random() < 0.35 else f"{head}{main}{tail}" if r.random() < 0.7 else f"{head}<main>{main}</main>{tail}"
        return f"<!DOCTYPE html><html><head><title>t</title></head><body>{main}</body></html>", self.marks


def labelled(page: str, marks: list[tuple[str, int]]) -> tuple[Dom, list[int]]:
    """A tree and its states: content are the root of the main text and, below it, what holds a text of it."""
    dom = parse(page)
    want = dict(marks)
    n = len(dom.parent)
    good = [0] * n
    for i in range(n - 1, 0, -1):
        if dom.tag[i] == "" and dom.text[i].strip():
            good[i] = max((want.get(w, 0) for w in dom.text[i].split()[:1]), default=0)
        good[dom.parent[i]] += good[i]
    y = [0] * n
    for i in range(n):
        root = (ROOT_MARK,) in dom.names[i]
        bare = dom.tag[i] in (" ", "br", "img", "hr")
        y[i] = int(root or i > 0 and y[dom.parent[i]] == 1 and (good[i] > 0 or bare))
        dom.names[i] = tuple(w for w in dom.names[i] if w != (ROOT_MARK,))
    return dom, y


def trained(n: int = 2400, seed: int = 11) -> Model:
    model = Model()
    for page, marks in training_pages(n, seed):
        model.learn(*labelled(page, marks))
    return model.ready()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row."""
    spark = pages.sparkSession
    ship(spark)
    model = trained()
    shared = spark.sparkContext.broadcast((model.lean, model.step))

    @F.pandas_udf("string")
    @lean
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model()
        own.lean, own.step = shared.value
        for html in batches:
            yield pd.Series([extract_text(h, own) for h in html], index=html.index, dtype=object)

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(F.col(html_col)).alias("text"))
