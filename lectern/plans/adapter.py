"""Plain tables as documents: a language is a corpus, a document a book, a line a chapter, a sentence a verse.

Everything here stays in the JVM, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import lemma_column, may_hold, sentence_array, surface_array
from ..operators.index import token_rows

#: Lines of a document that a segment number has room for.
ROOM = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are fewer than they are: words are many times the work of reading them."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return df.repartition(cores) if few else df


def sentences(documents: DataFrame, words: Iterable[str] | None = None) -> DataFrame:
    """corpus_id, book_ord, chapter, v_first, v_last, segment, text of each sentence. words: texts, lines and sentences that cannot hold any of these lemmas are passed over."""
    some = lambda df, c: df if words is None else df.where(may_hold(F.col(c), words))
    documents = some(spread(documents.select("lang", "doc_id", "text")), "text")
    lines = documents.select(F.col("lang").alias("corpus_id"), F.col("doc_id").alias("book_ord"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("l", "line"))
    each = some(lines, "line").select("corpus_id", "book_ord", (F.col("l") + 1).alias("chapter"), F.posexplode(sentence_array(F.col("line"))).alias("s", "text"))
    verse = F.col("s") + 1
    return some(each, "text").select("corpus_id", "book_ord", "chapter", verse.alias("v_first"), verse.alias("v_last"), (F.col("chapter").cast("long") * ROOM + verse).alias("segment"), "text")


CARRY = ("corpus_id", "book_ord", "chapter", "v_first", "v_last", "segment")


def postings(documents: DataFrame, words: Iterable[str] | None = None) -> DataFrame:
    """The postings of the documents, without places in the sentence; of some lemmas only, if words are given."""
    tokens = sentences(documents, words).select(*CARRY, F.posexplode(surface_array(F.col("text"))).alias("pos", "surface"))
    out = tokens.withColumn("lemma", lemma_column(F.col("surface")))
    return out if words is None else out.where(F.col("lemma").isin(*words))


def document_words(documents: DataFrame) -> DataFrame:
    """corpus_id, book_ord, segment, pos, surface, lemma of all words, numbered through a document: no word goes on beyond a line or a sentence, so that they are the same words in the same order."""
    words = spread(documents.select("lang", "doc_id", "text")).select(F.col("lang").alias("corpus_id"), F.col("doc_id").alias("book_ord"), F.lit(0).alias("segment"), F.posexplode(surface_array(F.coalesce("text", F.lit("")))).alias("pos", "surface"))
    return words.withColumn("lemma", lemma_column(F.col("surface")))


def placed_postings(some: DataFrame) -> DataFrame:
    """The postings of some sentences, with start and end offsets in them."""
    tokens = token_rows(some, "text", *CARRY)
    return tokens.select(*CARRY, "pos", "surface", "lemma", F.col("start_at").alias("start"), F.col("end_at").alias("end"))


def nodes(documents: DataFrame) -> DataFrame:
    """The node rows of the documents: for each line a chapter and a paragraph, in it a verse mark and a text for each sentence."""
    s = sentences(documents)
    root = (F.col("chapter") - 1) * 2
    base = F.col("chapter").cast("long") * ROOM * 2

    def rows(df: DataFrame, kind: str, path, seq, text=None, first=None, last=None, children=0):
        null = F.lit(None)
        return df.select(
            "corpus_id", "book_ord", path.alias("path"), seq.alias("seq"), F.size(path).alias("depth"), F.lit(kind).alias("type"), (F.lit("p") if kind == "para" else null.cast("string")).alias("marker"), (text if text is not None else null.cast("string")).alias("text"),
            (first if first is not None else null.cast("int")).alias("number_first"), (last if last is not None else null.cast("int")).alias("number_last"), F.lit(False).alias("is_title"), F.lit(children).alias("child_count"),
            null.cast("string").alias("alt_number"), null.cast("string").alias("pub_number"), F.col("chapter"), (F.col("v_first") if kind in ("verse", "text") else null.cast("int")).alias("v_first"), (F.col("v_last") if kind in ("verse", "text") else null.cast("int")).alias("v_last"),
        )

    lines = spread(documents.select("lang", "doc_id", "text")).select(F.col("lang").alias("corpus_id"), F.col("doc_id").alias("book_ord"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("l", "line")).select("corpus_id", "book_ord", (F.col("l") + 1).alias("chapter")).withColumns({"v_first": F.lit(None).cast("int"), "v_last": F.lit(None).cast("int")})
    inner = (F.col("v_first") - 1) * 2
    parts = [
        rows(lines, "chapter", F.array(root), base, first=F.col("chapter"), last=F.col("chapter")),
        rows(lines, "para", F.array(root + 1), base + 1, children=1),
        rows(s, "verse", F.array(root + 1, inner), base + 2 * F.col("v_first"), first=F.col("v_first"), last=F.col("v_last")),
        rows(s, "text", F.array(root + 1, inner + 1), base + 2 * F.col("v_first") + 1, text=F.col("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The same postings in SQL.
SENTENCES_SQL = r"""
l AS (SELECT lang AS corpus_id, doc_id AS book_ord, unnest(ls) AS line, generate_subscripts(ls, 1) AS chapter FROM (SELECT lang, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
s AS (SELECT corpus_id, book_ord, chapter, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS verse FROM (SELECT *, regexp_extract_all(line, '[^.!?]+[.!?]*') AS ss FROM l))"""
POSTINGS_SQL = (
    SENTENCES_SQL
    + r""",
w AS (SELECT corpus_id, book_ord, chapter, verse, unnest(ws) AS surface, generate_subscripts(ws, 1) AS pos FROM (SELECT *, regexp_extract_all(sentence, '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*') AS ws FROM s)),
p AS (SELECT *, strip_accents(lower(surface)) AS lemma FROM w)"""
)
