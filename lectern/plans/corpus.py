"""Plain documents as files of the engine's own formats, so that queries run the readers, the nodes and the index themselves.

A document is a book: its id modulo the books of two Testaments. A line is a chapter, a sentence a verse, with numbers from 1 to 255 over and over. Names stand in the head of
some books, every fourth verse has a note, and in every third chapter a heading parts the verses after the third.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import load
from ..functions.tokens import sentence_array
from ..operators import nodes as node_ops
from ..session import stored
from .adapter import spread, table

BOOKS, MOST = 66, 255
#: Every how many ids a document has the name, by its marker.
NAMES = {"h": 2, "toc1": 3, "toc2": 5, "toc3": 7}


def quoted(c: Column) -> Column:
    """A string as JSON."""
    array = F.to_json(F.array(c))
    return array.substr(F.lit(2), F.length(array) - 2)


def _para(marker: str, content: Column) -> Column:
    return F.concat(F.lit(f'{{"type":"para","marker":"{marker}","content":['), content, F.lit("]}"))


def _number(at: Column) -> Column:
    return (F.pmod(at, F.lit(MOST)) + 1).cast("string")


def _verses(sentences: Column, first: int) -> Column:
    def one(text: Column, i: Column) -> Column:
        n = i + first
        note = F.when((n + 1) % 4 == 0, F.lit(',{"type":"note","marker":"f","caller":"+","content":[{"type":"char","marker":"ft","content":["see"]}]}')).otherwise("")
        return F.concat(F.lit('{"type":"verse","marker":"v","number":"'), _number(n), F.lit('"},'), quoted(text), note)

    return F.array_join(F.transform(sentences, one), ",")


def _chapter(line: Column, i: Column) -> Column:
    start = F.concat(F.lit('{"type":"chapter","marker":"c","number":"'), _number(i), F.lit('"},'))

    def paras(s: Column) -> Column:
        parted = F.concat(_para("p", _verses(F.slice(s, 1, 3), 0)), F.lit(","), _para("s1", F.lit('"Heading"')), F.lit(","), _para("p", _verses(F.slice(s, 4, F.greatest(F.size(s), F.lit(1))), 3)))
        return F.when(((i + 1) % 3 == 0) & (F.size(s) > 3), parted).otherwise(_para("p", _verses(s, 0)))

    # a variable: the line is cut into sentences once, not for each use of them
    return F.concat(start, F.transform(F.array(sentence_array(line)), paras)[0])


def files(documents: DataFrame, corpus: Column) -> DataFrame:
    """(corpus_id, path, kind, text) of each document as a JSON tree."""
    codes = load().frame(documents.sparkSession).select(F.col("ord").alias("book_ord"), F.col("usfm_id").alias("code"))
    docs = spread(documents.select("doc_id", "text", corpus.alias("corpus_id"))).withColumn("book_ord", (F.col("doc_id") % BOOKS).cast("int")).join(F.broadcast(codes), "book_ord")  # 113 books
    name = lambda m: F.when(F.col("doc_id") % NAMES[m] == 0, F.concat(_para(m, F.concat(F.lit(f'" {m} É'), F.col("doc_id").cast("string"), F.lit('"'))), F.lit(","))).otherwise("")
    chapters = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), _chapter), ",")
    head = F.concat(F.lit('{"type":"USJ","version":"3.1","content":[{"type":"book","marker":"id","code":"'), F.col("code"), F.lit('","content":["about '), F.col("doc_id").cast("string"), F.lit('"]},'))
    text = F.concat(head, *[name(m) for m in NAMES], chapters, F.lit("]}"))
    return docs.select("corpus_id", F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".usj")).alias("path"), F.lit("usj").alias("kind"), text.alias("text"))


def usfm_files(documents: DataFrame) -> DataFrame:
    """The documents in the marker text format; signs that it uses are left out of the texts."""
    codes = load().frame(documents.sparkSession).select(F.col("ord").alias("book_ord"), F.col("usfm_id").alias("code"))
    docs = spread(documents.select("doc_id", "text", "lang")).withColumn("book_ord", (F.col("doc_id") % BOOKS).cast("int")).join(F.broadcast(codes), "book_ord")
    plain = F.translate(F.coalesce("text", F.lit("")), "\\|~/", "")

    def chapter(line: Column, i: Column) -> Column:
        verse = F.transform(sentence_array(line), lambda t, k: F.concat(F.lit("\\v "), _number(k), F.lit(" "), t))
        return F.concat(F.lit("\\c "), _number(i), F.lit("\n\\p\n"), F.array_join(verse, "\n"))

    text = F.concat(F.lit("\\id "), F.col("code"), F.lit(" about\n"), F.array_join(F.transform(F.split(plain, "\n"), chapter), "\n"))
    return docs.select(sole().alias("corpus_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".usfm")).alias("path"), F.lit("usfm").alias("kind"), text.alias("text"))


def sole() -> Column:
    """A corpus in which every document is a book of its own."""
    return F.concat_ws("-", F.col("lang"), F.floor(F.col("doc_id") / BOOKS).cast("string"))


def corpus_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the documents, which are parsed and placed once, and stored: what follows reads them several times."""
    return node_ops.placed_nodes(stored(node_ops.parse_placed(files(table(spark, sf_dir, "documents"), sole()))))


#: The same in SQL: documents (d), lines (l), sentences (s) and words (w) with their numbers.
CORPUS_SQL = r"""WITH d AS (SELECT doc_id, lang || '-' || CAST(doc_id // 66 AS VARCHAR) AS corpus_id, CAST(doc_id % 66 AS INTEGER) AS book_ord, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, corpus_id, book_ord, line, CAST((line - 1) % 255 + 1 AS INTEGER) AS chapter, regexp_extract_all(content, '[^.!?]+[.!?]*') AS ss FROM (SELECT doc_id, corpus_id, book_ord, unnest(ls) AS content, generate_subscripts(ls, 1) AS line FROM d)),
s AS (SELECT doc_id, corpus_id, book_ord, line, chapter, nth, CAST((nth - 1) % 255 + 1 AS INTEGER) AS verse, sentence, line % 3 = 0 AND len(ss) > 3 AS parted FROM (SELECT *, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS nth FROM l)),
w AS (SELECT *, strip_accents(lower(surface)) AS lemma FROM (SELECT *, unnest(ws) AS surface, generate_subscripts(ws, 1) AS k FROM (SELECT *, regexp_extract_all(sentence, '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*') AS ws FROM s)))
"""
#: Headings: lines (h) that have one.
HEADED = "h AS (SELECT * FROM l WHERE line % 3 = 0 AND len(ss) > 3)"
