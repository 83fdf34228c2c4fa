"""The nodes of documents: one row a node, with the chapter and verse that hold there."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.catalog import Catalog, load
from ..session import small_batches, stored
from ..sources.usfm import read_usfm
from ..sources.usj import NODE_FIELDS, Columns, DocumentError, books_in, read_json
from ..sources.usj_variant import parse_trees

_FILE, _SAID = ("corpus_id", "path_name", "code_found"), ("severity", "message", "position")
_RAW = f"corpus_id string, path_name string, code_found string, {NODE_FIELDS}, severity string, message string, position int"
KEYS = ("corpus_id", "book_ord")
#: Rows that a worker gives out at once: it holds these and the tree of one file.
AT_ONCE = 10_000


def parse_files(files: DataFrame, trees_in_jvm: bool = False) -> DataFrame:
    """files (corpus_id, path, kind, text) as node rows and diagnostic rows; a file that cannot be read yields one error.

    trees_in_jvm: JSON trees are walked as VARIANT, so that only marker texts need a Python worker.
    """
    if trees_in_jvm:
        return parse_trees(files.where("kind = 'usj'")).unionByName(parse_files(files.where("kind <> 'usj'")))
    return _read(files, _RAW)


def parse_placed(files: DataFrame) -> DataFrame:
    """parse_files with the chapter and verses that hold at each node: a file is read as a whole, so that its order needs no shuffle."""
    return _read(files, f"{_RAW}, chapter int, v_first int, v_last int")


def parse_books(files: DataFrame) -> DataFrame:
    """Which book each file is: a row a file, without its nodes."""
    return _read(files, "corpus_id string, path_name string, code_found string")


def _read(files: DataFrame, fields: str) -> DataFrame:
    schema = to_arrow_schema(T._parse_datatype_string(fields))
    small_batches(files.sparkSession)
    return files.mapInArrow(lambda batches: read_batches(batches, schema), fields)


def read_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Files as rows, AT_ONCE of them in a batch at most: a batch of files may hold millions. Without nodes in the schema, a row a file."""
    whole = "seq" in schema.names
    rows, own = Columns(), {name: [] for name in (*_FILE, *_SAID)}

    def read_one(corpus: str, path: str, kind: str, text: str) -> None:
        start, code = rows.size, None
        try:
            tree, said = (read_json(text), []) if kind == "usj" else read_usfm(text)
            code = next((n["code"] for n in books_in(tree)), None)
            if whole:
                rows.add(tree)
        except DocumentError as e:
            said = [{"severity": "error", "message": str(e)}]
        if not whole:
            said = [{}]
        nodes = rows.size - start
        for _ in said:
            rows.skip()
        for name, value in zip(_FILE, (corpus, path, code), strict=True):
            own[name] += [value] * (nodes + len(said))
        for name in _SAID:
            own[name] += [None] * nodes + [x.get(name) for x in said]

    def given_out() -> Iterator[pa.RecordBatch]:
        out = pa.RecordBatch.from_arrays([pa.array(own[f.name] if f.name in own else rows.column(f.name), f.type) for f in schema], schema=schema)
        step = -(-rows.size // -(-rows.size // AT_ONCE))
        for at in range(0, rows.size, step):  # a file has many nodes
            yield out.slice(at, step)

    for batch in batches:
        for corpus, path, kind, text in zip(*(batch.column(c) for c in ("corpus_id", "path", "kind", "text")), strict=True):
            read_one(corpus.as_py(), path.as_py(), kind.as_py(), text.as_py())
            if rows.size >= AT_ONCE:  # a batch holds many files
                yield from given_out()
                rows, own = Columns(), {name: [] for name in own}
    if rows.size:
        yield from given_out()


def books_of(parsed: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Which file is which book: of files of one book the first path counts, the others are marked ignored."""
    dim = (catalog or load()).frame(parsed.sparkSession).select(F.col("ord").alias("book_ord"), F.col("usfm_id"))
    found = parsed.where("code_found is not null").select("corpus_id", "path_name", "code_found").distinct()
    # 113 books
    found = found.join(F.broadcast(dim), F.col("code_found") == F.col("usfm_id")).drop("usfm_id")
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("path_name"))
    return found.withColumn("ignored", rank > 1)


def nodes(parsed: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Node rows of the counted files, with book_ord and the current chapter and verses.

    parsed is read once and shuffled once, by book: in the order of paths the first one of a book shows which file counts (as books_of tells it), and the same order serves the coordinates.
    """
    dim = (catalog or load()).frame(parsed.sparkSession).select(F.col("ord").alias("book_ord"), "usfm_id")
    rows = parsed.where("seq is not null and corpus_id is not null and path_name is not null").drop("severity", "message", "position")
    # 113 books
    rows = rows.join(F.broadcast(dim), F.col("code_found") == F.col("usfm_id")).drop("usfm_id", "code_found")
    first = F.first("path_name").over(Window.partitionBy(*KEYS).orderBy("path_name", "seq").rowsBetween(Window.unboundedPreceding, 0))
    counted = rows.withColumn("first_path", first).where("path_name = first_path").drop("first_path")
    return with_coordinates(counted, "path_name").drop("path_name")


def placed_nodes(placed: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """What nodes() gives, from the rows of parse_placed that are stored: they are read twice, and only a row a file is shuffled.

    Files that do not count are few as a rule, and reach the rows in a join with these.
    """
    dim = (catalog or load()).frame(placed.sparkSession).select(F.col("ord").alias("book_ord"), "usfm_id")
    ignored = stored(books_of(placed.where("seq = 0"), catalog).where("ignored").select("corpus_id", "path_name"))
    rows = placed.where("seq is not null and corpus_id is not null and path_name is not null").drop(*_SAID)
    # 113 books
    rows = rows.join(F.broadcast(dim), F.col("code_found") == F.col("usfm_id")).drop("usfm_id", "code_found")
    return rows.join(ignored, ["corpus_id", "path_name"], "left_anti").drop("path_name")


def diagnostics(parsed: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """What the parsers said, and files that were ignored as their book is there already, or that are no book."""
    said = parsed.where("severity is not null").select("corpus_id", F.col("path_name").alias("path"), "severity", "message", "position")
    twice = books_of(parsed, catalog).where("ignored").select("corpus_id", F.col("path_name").alias("path"), F.lit("warning").alias("severity"), F.lit("the book is there already").alias("message"), F.lit(None).cast("int").alias("position"))
    return said.unionByName(twice)


def with_coordinates(rows: DataFrame, *keys: str) -> DataFrame:
    """chapter, v_first, v_last of every node: the chapter and verse node before it, or it; a chapter ends a verse. keys: those of a file, beside its book's."""
    sofar = Window.partitionBy(*KEYS, *keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    is_chapter, is_verse = F.col("type") == "chapter", F.col("type") == "verse"
    chapter = F.last(F.when(is_chapter, F.col("number_first")), ignorenulls=True).over(sofar)
    at_chapter = F.last(F.when(is_chapter, F.col("seq")), ignorenulls=True).over(sofar)
    verse = F.last(F.when(is_verse, F.struct("seq", "number_first", "number_last")), ignorenulls=True).over(sofar)
    out = rows.withColumns({"chapter": chapter, "at_chapter": at_chapter, "verse": verse})
    holds = F.col("verse.seq") > F.col("at_chapter")
    return out.withColumns({"v_first": F.when(holds, F.col("verse.number_first")), "v_last": F.when(holds, F.col("verse.number_last"))}).drop("verse", "at_chapter")


def chapter_list(n: DataFrame) -> DataFrame:
    """The chapters of each book in document order: those at the root."""
    return n.where("type = 'chapter' and depth = 1").select(*KEYS, "seq", F.col("number_first").alias("number"), "alt_number", "pub_number")


def has_chapter(n: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of wanted (corpus_id, book_ord, chapter) that exist."""
    there = chapter_list(n).select(*KEYS, F.col("number").alias("chapter"))
    return wanted.join(there, [*KEYS, "chapter"], "left_semi")


def book_info(n: DataFrame) -> DataFrame:
    """code and description of each book, from its first book node."""
    # texts outside of paragraphs are few
    text = n.where("type = 'text' and not in_para").select(*KEYS, (F.col("seq") - 1).alias("seq"), "text")
    first = n.where("type = 'book'").groupBy(*KEYS).agg(F.min_by(F.struct("seq", "code"), "seq").alias("b")).select(*KEYS, "b.seq", "b.code")
    return first.join(text, [*KEYS, "seq"], "left").select(*KEYS, "code", F.col("text").alias("description"))


NAME_MARKERS = {"h": "running_header", "h1": "running_header", "toc1": "long", "toc2": "short", "toc3": "abbreviation"}


def translated_book_info(n: DataFrame) -> DataFrame:
    """Names of each book from paragraphs before the first chapter that hold one text; the last wins until all four are set."""
    first = n.where("type = 'chapter'").groupBy(*KEYS).agg(F.min("seq").alias("first_chapter"))
    heads = n.where(F.col("type") == "para").where(F.col("marker").isin(*NAME_MARKERS)).where("child_count = 1 and depth = 1")
    # no chapter holds at them, and they stand right below a paragraph at the root: few of all texts
    texts = n.where("type = 'text' and chapter is null and depth = 2").select(*KEYS, (F.col("seq") - 1).alias("seq"), F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("name"))
    rows = heads.join(first, [*KEYS], "left").where("first_chapter is null or seq < first_chapter").join(texts, [*KEYS, "seq"])
    kind = F.create_map(*[F.lit(x) for kv in NAME_MARKERS.items() for x in kv])[F.col("marker")]
    rows = rows.select(*KEYS, "seq", kind.alias("kind"), "name")
    # the place where all four kinds have been seen: names after it no longer count
    each = rows.groupBy(*KEYS, "kind").agg(F.min("seq").alias("at")).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("kinds"), F.max("at").alias("full"))
    rows = rows.join(each, [*KEYS]).where("kinds < 4 or seq <= full")
    return rows.groupBy(*KEYS).agg(*[F.max_by("name", F.when(F.col("kind") == k, F.col("seq"))).alias(k) for k in dict.fromkeys(NAME_MARKERS.values())])


def short_name(info: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """The best short name of each book: short, running header, abbreviation, long, id."""
    dim = (catalog or load()).frame(info.sparkSession).select(F.col("ord").alias("book_ord"), "usfm_id")
    return info.join(F.broadcast(dim), "book_ord").withColumn("simple_name", F.coalesce("short", "running_header", "abbreviation", "long", "usfm_id"))


def names(info: DataFrame) -> DataFrame:
    """alias_key, book_ord of every name in a document."""
    from ..functions.normalize import normalize_column

    each = info.select(*KEYS, F.explode(F.array_compact(F.array("running_header", "long", "short", "abbreviation"))).alias("name"))
    return each.select("corpus_id", "book_ord", normalize_column(F.col("name")).alias("alias_key"), F.lit("document").alias("source")).distinct()


def marker_histogram(n: DataFrame) -> DataFrame:
    return n.where("type <> 'text'").groupBy("corpus_id", F.coalesce("marker", "type").alias("marker_or_type")).agg(F.count(F.lit(1)).alias("n"))


def unsupported(n: DataFrame, supported: list[str]) -> DataFrame:
    """Nodes whose marker a client does not show, by book and chapter."""
    return n.where("type <> 'text'").where(~F.coalesce("marker", "type").isin(*supported)).groupBy(*KEYS, "chapter").agg(F.count(F.lit(1)).alias("n"))


def note_labels(n: DataFrame) -> DataFrame:
    """Notes with a generated caller, numbered in page order and lettered a, b, … z, aa."""
    from ..functions.markers import alpha_label

    notes = n.where("type = 'note'")
    number = F.row_number().over(Window.partitionBy(*KEYS).orderBy("seq"))
    return notes.where("caller = '+'").select(*KEYS, "seq", number.alias("note_no")).withColumn("label", alpha_label(F.col("note_no").cast("long")))
