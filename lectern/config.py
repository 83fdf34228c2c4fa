"""Engine settings from the environment, and the configuration of a corpus from TOML."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

from .functions.catalog import Catalog
from .functions.normalize import normalize_key


class ConfigError(ValueError):
    status = 400


@dataclass(frozen=True)
class EngineConfig:
    """Where corpora, snapshots and short links live, and which corpora are served."""

    corpora_dir: str = "corpora"
    snapshot_dir: str = "snapshots"
    links_path: str = "short_links"
    default_corpus: str | None = None
    disabled: frozenset[str] = frozenset()
    read_only_links: bool = False

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> EngineConfig:
        env = dict(os.environ) if env is None else env
        return cls(
            corpora_dir=env.get("CORPORA_DIR", cls.corpora_dir),
            snapshot_dir=env.get("SNAPSHOT_DIR", cls.snapshot_dir),
            links_path=env.get("LINKS_PATH", cls.links_path),
            default_corpus=env.get("DEFAULT_CORPUS"),
            disabled=frozenset(x.strip() for x in env.get("DISABLED_CORPORA", "").split(",") if x.strip()),
            read_only_links=env.get("LINKS_READ_ONLY", "").lower() in ("1", "true", "yes"),
        )


@dataclass
class FootnoteRule:
    """A phrase (lemmas), the inclusive span of references it holds in, its note, and its rank: later rules win."""

    phrase: tuple[str, ...]
    low: tuple[int, int, int, int]
    high: tuple[int, int, int, int]
    note: str
    priority: int


@dataclass
class CorpusConfig:
    display_name: str | None = None
    text_direction: str = "auto"
    book_order: list[list[int]] | None = None
    book_aliases: dict[int, list[str]] = field(default_factory=dict)
    index: bool = True
    languages: list[str] | None = None
    ignored_words: list[str] = field(default_factory=list)
    footnotes: list[FootnoteRule] = field(default_factory=list)


def order_groups(names: list[str], catalog: Catalog) -> list[list[int]]:
    """Groups of neighbouring books; an empty name parts groups. A book may stand once only."""
    groups: list[list[int]] = [[]]
    for name in names:
        if name == "":
            groups.append([])
        else:
            book = catalog.find(name)
            if book is None:
                raise ConfigError(f"book_order: unknown book {name!r}")
            groups[-1].append(book.ord)
    flat = [o for g in groups for o in g]
    if twice := sorted({o for o in flat if flat.count(o) > 1}):
        raise ConfigError(f"book_order: books with two neighbours: {twice}")
    return [g for g in groups if g]


def alias_products(spec: object, common: dict[str, list[str]]) -> list[str]:
    """Strings that an alias stands for: itself, or all concatenations of its groups (a named list, or a literal list)."""
    if isinstance(spec, str):
        return [spec]
    out = [""]
    for group in spec:  # type: ignore[union-attr]
        if isinstance(group, str):
            if group not in common:
                raise ConfigError(f"unknown common alias {group!r}")
            choices = common[group]
        else:
            choices = list(group)
        out = [a + b for a in out for b in choices]
    return out


def parse_config(text: str, catalog: Catalog) -> CorpusConfig:
    """The configuration of a corpus; every value has a default, and unknown keys are ignored."""
    from .functions.references import parse_references
    from .functions.tokens import lemma, lemmas

    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    out = CorpusConfig(display_name=raw.get("display_name"), text_direction=raw.get("text_direction", "auto"))
    if out.text_direction not in ("auto", "ltr", "rtl"):
        raise ConfigError(f"text_direction: {out.text_direction!r}")
    if "book_order" in raw:
        out.book_order = order_groups(raw["book_order"], catalog)
    aliases = raw.get("book_aliases", {})
    for name, specs in aliases.get("books", {}).items():
        book = catalog.find(name)
        if book is None:
            raise ConfigError(f"book_aliases: unknown book {name!r}")
        out.book_aliases[book.ord] = [a for s in specs for a in alias_products(s, aliases.get("common", {}))]
    search = raw.get("search", {})
    out.index, out.languages = search.get("index", True), search.get("languages")
    out.ignored_words = sorted({lemma(normalize_key(w, out.languages)) for w in search.get("ignored_words", [])})

    def bound(reference: str) -> tuple[int, int, int, int]:
        found = parse_references(reference, catalog)
        if len(found) != 1 or found[0].error:
            raise ConfigError(f"footnotes: not one reference: {reference!r}")
        return found[0].key()

    priority = 0
    for phrase, rules in raw.get("footnotes", {}).items():
        for rule in rules:
            for span in rule["bible_ranges"] if "bible_ranges" in rule else rule.get("ranges", []):
                a, b = (span, span) if isinstance(span, str) else span
                low, high = bound(a), bound(b)
                if a == b:  # one reference covers each of its verses
                    low, high = (*low[:2], low[2], low[2]), (*high[:2], high[3], 255)
                else:
                    low, high = (*low[:2], low[2], 0), (*high[:2], high[3], 255)
                out.footnotes.append(FootnoteRule(tuple(lemmas(phrase, out.languages)), low, high, rule["footnote"], priority))
                priority += 1
    return out
