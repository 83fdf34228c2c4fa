"""Keeping nodes and postings up to date as files come, change, move and go.

A file stream says that something came; as it does not tell of files that went, each batch also compares the names and times below the root
with the manifest of what was read. A change of documents is a set of (corpus, book) keys: the old rows of those keys go and new ones come, by dynamic
partition overwrite of the buckets that hold them; a bucket without rows in a table goes. A change of a corpus's configuration that its index depends on (whether it is
indexed, its ignored words, the scripts of its languages) makes its postings anew from the stored nodes. A full rebuild gives the same tables.

The manifest and the configurations are one small file, moved into place when the tables are written, so that an update that fails is done again.
"""

from __future__ import annotations

import contextlib
import json
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ConfigError, CorpusConfig, parse_config
from ..engine import Engine
from ..functions.catalog import Catalog, load
from ..functions.tokens import scripts
from ..operators.nodes import books_of, nodes, parse_files
from ..sources.files import CONFIG_NAME, OLD_CONFIG_NAMES, configs, documents, unpack
from ..sources.snapshot import read_snapshot, replace_books, write_meta, write_snapshot
from ..sources.store import Store

Key = tuple[str, int]
MANIFEST = "manifest.json"


def corpus_of(path: str) -> str | None:
    """The corpus of a file: its folder, or the stem of a zip file at the top."""
    first, slash, _ = path.partition("/")
    return first if slash else path[:-4] if path.lower().endswith(".zip") else None


def is_config(path: str) -> bool:
    return path.rpartition("/")[2] in (CONFIG_NAME, *OLD_CONFIG_NAMES)


class Maintainer:
    """One writer of the tables at `store` for the corpora below `root`."""

    def __init__(self, spark: SparkSession, root: str, store: str, catalog: Catalog | None = None):
        self.spark, self.root, self.store, self.catalog = spark, root.rstrip("/"), store.rstrip("/"), catalog or load()
        self.files, self.tables_at = Store(spark, self.root), Store(spark, self.store)
        self.lock = threading.Lock()

    @contextlib.contextmanager
    def exclusively(self) -> Iterator[None]:
        """A second writer at the same time is an error, not a wait."""
        if not self.lock.acquire(blocking=False):
            raise RuntimeError("the tables have a writer already")
        try:
            yield
        finally:
            self.lock.release()

    def manifest(self) -> tuple[dict[str, list], dict[str, str]]:
        """path -> [modified, [[corpus, book], ...]] of every file that was read, and the configuration of each corpus."""
        text = self.tables_at.read(MANIFEST)
        saved = json.loads(text) if text else {"files": {}, "configs": {}}
        return saved["files"], saved["configs"]

    def save(self, files: dict[str, list], texts: dict[str, str]) -> None:
        self.tables_at.write(MANIFEST, json.dumps({"files": files, "configs": texts}, sort_keys=True))

    def parsed_configs(self, texts: dict[str, str]) -> dict[str, CorpusConfig]:
        """A configuration that cannot be read counts as the default."""
        out = {}
        for corpus, text in texts.items():
            try:
                out[corpus] = parse_config(text, self.catalog)
            except ConfigError:
                out[corpus] = CorpusConfig()
        return out

    def load_files(self, paths: list[str]) -> DataFrame:
        """Some files below the root; nothing if there are none."""
        if not paths:
            return self.spark.createDataFrame([], "corpus_id string, path string, text string, kind string")
        return unpack(self.spark.read.format("binaryFile").load([f"{self.root}/{p}" for p in paths]), self.root)

    def books_in(self, paths: list[str]) -> dict[str, list[Key]]:
        """The books of each file; those of a zip file are all that its entries hold."""
        out: dict[str, list[Key]] = {p: [] for p in paths}
        zips = {corpus_of(p): p for p in paths if "/" not in p}
        for r in books_of(parse_files(documents(self.load_files(paths))), self.catalog).collect():
            own = f"{r['corpus_id']}/{r['path_name']}"
            place = own if own in out else zips.get(r["corpus_id"])
            if place:
                out[place].append([r["corpus_id"], r["book_ord"]])
        return out

    def rebuild(self) -> None:
        """Everything anew."""
        with self.exclusively():
            there = self.files.listing()
            files = self.load_files([p for p in there if corpus_of(p)])
            texts = configs(files)
            n = nodes(parse_files(documents(files)), self.catalog)
            write_snapshot(self.store, n, Engine.index_of(n, self.parsed_configs(texts)), texts)
            found = self.books_in([p for p in there if corpus_of(p) and not is_config(p)])
            self.save({p: [t, found.get(p, [])] for p, t in there.items()}, texts)

    def update(self) -> set[Key]:
        """Read what changed since the manifest; returns the (corpus, book) keys that were written anew or removed."""
        with self.exclusively():
            return self._update()

    def _update(self) -> set[Key]:
        (old, texts), now = self.manifest(), self.files.listing()
        changed = sorted(p for p, t in now.items() if p not in old or old[p][0] != t)
        gone = sorted(p for p in old if p not in now)
        if not changed and not gone:
            return set()
        new_texts = self.new_configs(texts, changed, gone)
        before, after = self.parsed_configs(texts), self.parsed_configs(new_texts)
        found = self.books_in([p for p in changed if corpus_of(p) and not is_config(p)])
        held = {p: found.get(p, [] if p in changed else old[p][1]) for p in now if p in found or p in old or p in changed}
        touched = {tuple(k) for p in [*changed, *gone] if p in old for k in old[p][1]} | {tuple(k) for keys in found.values() for k in keys}
        if touched:
            # other files of the touched books count too: an ignored one may take the place of one that went
            again = sorted(p for p, keys in held.items() if any(tuple(k) in touched for k in keys))
            fresh = nodes(parse_files(documents(self.load_files(again))), self.catalog).where(F.concat_ws("/", "corpus_id", "book_ord").isin([f"{c}/{b}" for c, b in touched]))
            self.put("nodes", fresh, touched)
            self.put("postings", Engine.index_of(self.of_books(touched), after), touched)
        for corpus in sorted({*before, *after}):
            if self.indexed_alike(before.get(corpus, CorpusConfig()), after.get(corpus, CorpusConfig())):
                continue
            own = read_snapshot(self.spark, self.store)[0].where(F.col("corpus_id") == corpus)
            keys = {(corpus, r[0]) for r in own.select("book_ord").distinct().collect()}
            self.put("postings", Engine.index_of(own, after), keys)
        write_meta(self.spark, self.store, new_texts)
        self.save({p: [now[p], held.get(p, [])] for p in now}, new_texts)
        return touched

    def new_configs(self, texts: dict[str, str], changed: list[str], gone: list[str]) -> dict[str, str]:
        lost = {corpus_of(p) for p in gone if is_config(p) or "/" not in p}
        read = [p for p in changed if is_config(p) or "/" not in p and corpus_of(p)]
        return {k: v for k, v in texts.items() if k not in lost} | configs(self.load_files(read))

    @staticmethod
    def indexed_alike(a: CorpusConfig, b: CorpusConfig) -> bool:
        return (a.index, a.ignored_words, scripts(a.languages)) == (b.index, b.ignored_words, scripts(b.languages))

    def of_books(self, keys: set[Key]) -> DataFrame:
        return read_snapshot(self.spark, self.store)[0].where(F.concat_ws("/", "corpus_id", "book_ord").isin([f"{c}/{b}" for c, b in keys]))

    def put(self, table: str, rows: DataFrame, keys: set[Key]) -> None:
        """Rows in place of those of the keys; keys without new rows lose theirs."""
        for bucket in replace_books(self.store, table, rows, keys):
            self.tables_at.delete(f"{table}/bucket={bucket}")

    def tables(self) -> tuple[DataFrame, DataFrame]:
        n, p, _ = read_snapshot(self.spark, self.store)
        return n, p

    def watch(self, checkpoint: str, every: str = "2 seconds", once: bool = False):
        """A streaming query that updates the tables for each batch of new or changed files."""
        schema = "path string, modificationTime timestamp, length long, content binary"
        stream = self.spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(self.root)
        writer = stream.select("path").writeStream.foreachBatch(lambda batch, _: self.update() and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
