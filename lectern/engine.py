"""The engine: corpora as tables, and one method for each thing that can be asked."""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CorpusConfig, EngineConfig, parse_config
from .functions.catalog import Catalog, load
from .functions.markers import text_direction
from .functions.normalize import normalize_key
from .functions.references import Parser, Part
from .functions.tokens import scripts
from .operators import footnotes, navigation, search
from .operators import index as ix
from .operators import nodes as nd
from .operators import passages as ps
from .operators.links import JdbcLinks, LinkStore
from .sources import files as fl
from .sources.snapshot import read_snapshot, write_snapshot


class NotFound(LookupError):
    status = 404


class BadRequest(ValueError):
    status = 400


class Engine:
    """nodes and postings of all corpora, and a configuration for each."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, postings: DataFrame, configs: dict[str, CorpusConfig], config: EngineConfig | None = None, catalog: Catalog | None = None, config_texts: dict[str, str] | None = None):
        self.spark, self.nodes, self.postings, self.configs = spark, nodes, postings, configs
        self.config, self.catalog = config or EngineConfig(), catalog or load()
        self.config_texts = config_texts or {}
        links = self.config.links_path
        self.links = LinkStore(spark, JdbcLinks(spark, links) if links.startswith("jdbc:") else links, self.catalog, self.config.read_only_links)

    @classmethod
    def from_folder(cls, spark: SparkSession, root: str, config: EngineConfig | None = None, catalog: Catalog | None = None) -> Engine:
        """The corpora below a folder. They are read once: nodes and postings stay on the executors' disks until close()."""
        config, catalog = config or EngineConfig(corpora_dir=root), catalog or load()
        files = fl.read_files(spark, root, config.disabled)
        texts = fl.configs(files)
        configs = {k: parse_config(t, catalog) for k, t in texts.items()}
        n = nd.nodes(nd.parse_files(fl.documents(files)), catalog).persist(StorageLevel.DISK_ONLY)
        return cls(spark, n, cls.index_of(n, configs).persist(StorageLevel.DISK_ONLY), configs, config, catalog, texts)

    def close(self) -> None:
        """Give back what from_folder keeps."""
        self.postings.unpersist()
        self.nodes.unpersist()

    @staticmethod
    def index_of(n: DataFrame, configs: dict[str, CorpusConfig]) -> DataFrame:
        """Postings of all corpora that are indexed, each without its own ignored words."""
        off = [k for k, c in configs.items() if not c.index]
        n = n.where(~F.col("corpus_id").isin(off)) if off else n
        # corpora that read their text alike are indexed together
        own: dict[tuple[str, ...], list[str]] = {}
        for corpus, c in configs.items():
            if c.index and scripts(c.languages) != scripts():
                own.setdefault(tuple(c.languages), []).append(corpus)
        special = [k for group in own.values() for k in group]
        p = ix.postings(n.where(~F.col("corpus_id").isin(special)) if special else n)
        for languages, group in own.items():
            p = p.unionByName(ix.postings(n.where(F.col("corpus_id").isin(group)), languages=list(languages)))
        for corpus, c in configs.items():
            if c.ignored_words:
                p = p.where(~((F.col("corpus_id") == corpus) & F.col("lemma").isin(c.ignored_words)))
        return p

    @classmethod
    def from_snapshot(cls, spark: SparkSession, path: str, config: EngineConfig | None = None, catalog: Catalog | None = None) -> Engine:
        catalog = catalog or load()
        n, p, texts = read_snapshot(spark, path)
        return cls(spark, n, p, {k: parse_config(t, catalog) for k, t in texts.items()}, config, catalog, texts)

    def bake(self, path: str) -> dict[str, int]:
        """Write a snapshot; returns how many nodes, books and words it has."""
        return write_snapshot(path, self.nodes, self.postings, self.config_texts)

    def of(self, corpus: str) -> DataFrame:
        n = self.nodes.where(F.col("corpus_id") == corpus)
        if not n.take(1):
            raise NotFound(f"no corpus {corpus!r}")
        return n

    def corpus_config(self, corpus: str) -> CorpusConfig:
        return self.configs.get(corpus) or CorpusConfig()

    def corpora(self) -> dict:
        """The default corpus, and a record for each."""
        ids = sorted(r[0] for r in self.nodes.select("corpus_id").distinct().collect())
        return {"default_corpus": self.config.default_corpus or (ids[0] if ids else None), "corpora": {i: self.info(i) for i in ids}}

    def info(self, corpus: str) -> dict:
        n, c = self.of(corpus), self.corpus_config(corpus)
        names = nd.short_name(nd.translated_book_info(n), self.catalog).orderBy("book_ord").collect()
        direction = c.text_direction
        if direction == "auto":
            sample = n.where("type = 'text' and v_first is not null").orderBy("book_ord", "seq").limit(1).select(text_direction(F.col("text")).alias("d")).first()
            direction = sample["d"] if sample and sample["d"] else "auto"
        return {"display_name": c.display_name or corpus.upper(), "text_direction": direction, "simple_book_names": {r["usfm_id"]: r["simple_name"] for r in names}}

    def books(self, corpus: str) -> dict:
        n = self.of(corpus)
        names = {r["book_ord"]: r.asDict() for r in nd.translated_book_info(n).collect()}
        chapters: dict[int, list] = {}
        for r in nd.chapter_list(n).orderBy("book_ord", "seq").collect():
            own = {"number": r["number"], "alt_number": r["alt_number"], "pub_number": r["pub_number"]}
            chapters.setdefault(r["book_ord"], []).append({k: v for k, v in own.items() if v is not None})
        there = sorted(r[0] for r in n.select("book_ord").distinct().collect())
        keep = ("running_header", "long", "short", "abbreviation")
        books = {self.catalog[o].usfm_id: {"translated_book_info": {k: v for k, v in names.get(o, {}).items() if k in keep}, "chapters": chapters.get(o, [])} for o in there}
        order: list[str | None] = []
        for group in self.corpus_config(corpus).book_order or [[b.ord for b in self.catalog.books]]:
            order += ([None] if order else []) + [self.catalog[o].usfm_id for o in group]
        return {"books": books, "book_order": order}

    def book(self, corpus: str, name: str) -> dict:
        """The whole document of a book."""
        from .sources.usj import nest

        n = self.of(corpus)
        ord_ = self.parser(corpus, n).book(normalize_key(name))
        if ord_ is None:
            raise BadRequest(f"no book is named {name!r}")
        rows = [r.asDict(recursive=True) for r in n.where(F.col("book_ord") == ord_.ord).orderBy("seq").collect()]
        if not rows:
            raise NotFound(f"{corpus} has no {name}")
        return nest(rows)[0]

    def parser(self, corpus: str, n: DataFrame) -> Parser:
        """The names of a corpus: configured ones win over those in its documents; only books that it has may be named."""
        names = {r["alias_key"]: r["book_ord"] for r in nd.names(nd.translated_book_info(n)).collect()}
        names |= {normalize_key(a): o for o, aliases in self.corpus_config(corpus).book_aliases.items() for a in aliases}
        there = {r[0] for r in n.select("book_ord").distinct().collect()}
        return Parser(self.catalog, names, there.__contains__)

    def index(self, corpus: str) -> DataFrame:
        """name, total of every word, by name."""
        self.of(corpus)
        return ix.listing(ix.vocabulary(self.postings.where(F.col("corpus_id") == corpus))).select("name", "total")

    def search(self, corpus: str, term: str, start: int = 0, count: int = search.PAGE, generate_footnotes: bool = True, mode: str = "occurrence") -> dict:
        """Passages if any part of the term reads as a reference, else a page of the references that hold its words."""
        search.check_page(start, count)
        n = self.of(corpus)
        parts = self.parser(corpus, n).parse(term)
        if all(p.is_syntax for p in parts):
            return self.find_words(corpus, n, term, start, count, mode)
        return self.find_passages(corpus, n, term, parts, generate_footnotes)

    def find_words(self, corpus: str, n: DataFrame, term: str, start: int, count: int, mode: str) -> dict:
        p = self.postings.where(F.col("corpus_id") == corpus)
        languages = self.corpus_config(corpus).languages
        query = search.query_frame(self.spark, term, languages)
        p = search.probe(p, term, languages)
        found = search.hits(p, query, mode).cache()
        try:
            total = found.count()
            page = search.page(found, start, count).withColumn("req_id", F.monotonically_increasing_id()).collect()
        finally:
            found.unpersist()
        if not page:
            return {"response_type": "search_results", "search_term": term, "total_results": total, "references": []}
        wanted = self.spark.createDataFrame([(i, corpus, r["book_ord"], r["chapter"], r["v_first"], r["v_last"]) for i, r in enumerate(page)], "req_id long, corpus_id string, book_ord int, chapter int, v_first int, v_last int")
        starts = ps.bounds(n, wanted).select("req_id", F.col("start_at"))
        lights = search.highlights(p, query, wanted).join(wanted, ["corpus_id", *search.REF]).join(starts, "req_id", "left")
        lights = {r["req_id"]: r["h"] for r in lights.select("req_id", F.transform("highlights", lambda h: F.struct(ps.rebase(h["start"], F.col("start_at")).alias("start"), ps.rebase(h["end"], F.col("start_at")).alias("end"))).alias("h")).collect()}
        content = {r["req_id"]: json.loads(r["content"]) for r in ps.passages(n, wanted).collect()}
        items = []
        for i, r in enumerate(page):
            own = [h.asDict(recursive=True) for h in lights.get(i, [])]
            if content.get(i) and content[i][0].get("marker") == "cl":
                for h in own:  # the label stands before the passage
                    h["start"]["path"][0] += 1
                    h["end"]["path"][0] += 1
            items.append({"reference": self.reference(r["book_ord"], r["chapter"], r["v_first"], r["v_last"]), "content": content.get(i), "highlights": own})
        return {"response_type": "search_results", "search_term": term, "total_results": total, "references": items}

    def find_passages(self, corpus: str, n: DataFrame, term: str, parts: list[Part], generate_footnotes: bool) -> dict:
        refs = [(i, p.reference) for i, p in enumerate(parts) if p.reference]
        content, near = {}, {}
        if refs:
            wanted = self.spark.createDataFrame([(i, corpus, r.book, r.chapter, r.first, r.last) for i, r in refs], "req_id long, corpus_id string, book_ord int, chapter int, v_first int, v_last int")
            c = self.corpus_config(corpus)
            annotate = footnotes.annotator(c.footnotes, c.languages) if generate_footnotes and c.footnotes else None
            content = {r["req_id"]: json.loads(r["content"]) for r in ps.passages(n, wanted, annotate).collect()}
            order = navigation.book_order(self.spark, c.book_order, self.catalog)
            near = {r["req_id"]: r for r in navigation.adjacent_chapters(nd.chapter_list(n), wanted, order, self.catalog).collect()}
        items = []
        for i, p in enumerate(parts):
            if p.reference is None:
                details = {k: getattr(v, "usfm_id", v) for k, v in p.details.items()}
                items.append({"invalid_reference": p.message, "source_reference": p.source, "error_type": p.error, "details": details})
                continue
            r, around = p.reference, near.get(i)
            item = {"reference": self.reference(r.book, r.chapter, r.first, r.last), "content": content.get(i)}
            for key in ("previous_chapter", "next_chapter"):
                if around and around[key]:
                    item[key] = {"book": self.catalog[around[key]["book_ord"]].usfm_id, "chapter": around[key]["chapter"]}
            items.append(item)
        return {"response_type": "scripture_passages", "search_term": term, "total_results": len(parts), "references": items}

    def reference(self, book: int, chapter: int, first: int, last: int) -> dict:
        return {"book": self.catalog[book].usfm_id, "chapter": chapter, "verses": [first, last]}

    def short_create(self, references: str) -> dict:
        return self.links.create(references)

    def short_resolve(self, kind: str, value: str) -> list[str]:
        return self.links.resolve(kind, value)
