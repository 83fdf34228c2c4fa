"""The engine's operators as queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, markers, segmentation
from ..functions.catalog import load
from ..functions.references import parse_column
from ..functions.tokens import lemma_column, lemmas, surface_array, word_array
from ..operators import aliases, footnotes, index, intervals, navigation, passages, phrases, search
from ..operators import nodes as node_ops
from ..session import scratch, stored
from . import document_queries  # noqa: F401 - registers its queries
from .adapter import POSTINGS_SQL, SENTENCES_SQL, document_words, nodes, placed_postings, postings, sentences, spread, table
from .registry import QUERIES, SQL, dim_sql, query

STOP_WORDS = ("the", "of", "and", "der", "die", "und", "de", "la", "le", "el")
REF = "corpus_id, book_ord, chapter, verse"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# Index and vocabulary -------------------------------------------------------------------------------------------------


@query(f"WITH {POSTINGS_SQL} SELECT corpus_id, count(*) AS n, count(DISTINCT lemma) AS n_lemmas FROM p GROUP BY corpus_id")
def postings_count_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = postings(_docs(spark, sf_dir)).groupBy("corpus_id", "lemma").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("corpus_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_lemmas"))


@query(f"WITH {POSTINGS_SQL} SELECT corpus_id, lemma, count(*) AS total, coalesce(arg_min(surface, struct_pack(a := book_ord, b := chapter, c := verse, d := pos)) FILTER (WHERE surface <> lemma), lemma) AS name FROM p GROUP BY corpus_id, lemma")
def vocab_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.vocabulary(document_words(_docs(spark, sf_dir)))


@query(f"WITH {POSTINGS_SQL}, v AS (SELECT lemma, count(*) AS total, coalesce(arg_min(surface, struct_pack(a := book_ord, b := chapter, c := verse, d := pos)) FILTER (WHERE surface <> lemma), lemma) AS name FROM p WHERE corpus_id = 'en' GROUP BY lemma) SELECT name, total FROM v ORDER BY lower(name), total, name LIMIT 100 OFFSET 200")
def vocab_sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = document_words(_docs(spark, sf_dir)).where("corpus_id = 'en'")
    return index.listing(index.vocabulary(p)).select("name", "total").offset(200).limit(100)


@query(f"WITH {POSTINGS_SQL} SELECT corpus_id, count(DISTINCT (book_ord, lemma)) AS pairs, count(DISTINCT lemma) AS lemmas FROM p GROUP BY corpus_id")
def words_by_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = index.words_by_book(postings(_docs(spark, sf_dir)))
    return w.groupBy("corpus_id", "lemma").agg(F.count(F.lit(1)).alias("n")).groupBy("corpus_id").agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("lemmas"))


@query(f"WITH {POSTINGS_SQL} SELECT corpus_id, count(*) AS n FROM p WHERE lemma NOT IN {STOP_WORDS} GROUP BY corpus_id")
def stopword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(_docs(spark, sf_dir)).where(~F.col("lemma").isin(*STOP_WORDS))
    return p.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {POSTINGS_SQL}, c AS (SELECT corpus_id, lemma, count(*) AS n FROM p GROUP BY ALL), a AS (SELECT lemma FROM c WHERE corpus_id = 'en' AND n >= 20), b AS (SELECT lemma FROM c WHERE corpus_id = 'de' AND n >= 20) (SELECT lemma AS word FROM a EXCEPT SELECT lemma FROM b) UNION (SELECT lemma FROM b EXCEPT SELECT lemma FROM a)")
def stopword_symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = postings(_docs(spark, sf_dir)).where(F.col("corpus_id").isin("en", "de")).groupBy("corpus_id", F.col("lemma").alias("word")).agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
    return aliases.changed_words(counts.where("corpus_id = 'en'"), counts.where("corpus_id = 'de'"))


# Search ---------------------------------------------------------------------------------------------------------------


def _search_sql(term: str, mode: str = "occurrence", tail: str = "") -> str:
    values = ", ".join(f"('{w}')" for w in lemmas(term))
    count, n = ("count(*)", "(SELECT count(*) FROM k)") if mode == "occurrence" else ("count(DISTINCT p.lemma)", "(SELECT count(DISTINCT lemma) FROM k)")
    return f"WITH {POSTINGS_SQL}, q(lemma) AS (VALUES {values}), k AS (SELECT q.lemma FROM q WHERE q.lemma IN (SELECT lemma FROM p)), f AS (SELECT {REF}, count(*) AS occurrences FROM p JOIN q ON p.lemma = q.lemma GROUP BY ALL HAVING {count} = {n}) {tail or f'SELECT corpus_id, book_ord, chapter, verse AS v_first, verse AS v_last, occurrences FROM f'}"


def _hits(spark: SparkSession, sf_dir: str, term: str, mode: str = "occurrence") -> DataFrame:
    """Postings are made here, of the query's words only, and stored: hits reads them twice."""
    found = postings(_docs(spark, sf_dir), lemmas(term)).select("corpus_id", *search.REF, "lemma")
    return search.hits(stored(found), search.query_frame(spark, term), mode)


@query(_search_sql("worthless"))
def search_single_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "worthless")


@query(_search_sql("the and"))
def search_two_terms_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "the and")


@query(_search_sql("the and", "all_terms"))
def search_two_terms_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "the and", "all_terms")


@query(_search_sql("und und nosuchword"))
def search_dup_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "und und nosuchword")


@query(_search_sql("the", tail="SELECT corpus_id, book_ord, chapter, verse AS v_first, verse AS v_last, occurrences FROM f ORDER BY book_ord, chapter, verse LIMIT 50 OFFSET 100"))
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(_hits(spark, sf_dir, "the"), 100, 50)


@query(_search_sql("the and", tail="SELECT count(*) AS total_results, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM f"))
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "the and").agg(F.count(F.lit(1)).alias("total_results"), F.ceil(F.count(F.lit(1)) / 50).cast("long").alias("pages"))


@query(
    f"WITH {SENTENCES_SQL}, r AS (SELECT corpus_id, book_ord, chapter, verse, unnest(rs) AS run, generate_subscripts(rs, 1) AS k FROM (SELECT *, regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}]*|[^\\p{{L}}\\p{{N}}]+') AS rs FROM s)), "
    "o AS (SELECT *, sum(length(run)) OVER (PARTITION BY corpus_id, book_ord, chapter, verse ORDER BY k) AS e FROM r), "
    "h AS (SELECT * FROM o WHERE strip_accents(lower(run)) IN ('worthless', 'idiot')) "
    "SELECT corpus_id, book_ord, chapter, verse AS v_first, verse AS v_last, string_agg(CAST(e - length(run) AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY k) AS highlights FROM h GROUP BY corpus_id, book_ord, chapter, verse"
)
def search_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    q = search.query_frame(spark, "worthless idiot")
    found = postings(docs).join(F.broadcast(q), "lemma").select("corpus_id", "book_ord", "chapter", "v_first", "v_last").distinct()
    # places are worked out for the sentences that were found only
    some = sentences(docs).join(found, ["corpus_id", "book_ord", "chapter", "v_first", "v_last"], "left_semi")
    lights = search.highlights(placed_postings(some), q, found)
    return lights.withColumn("highlights", F.array_join(F.transform("highlights", lambda h: F.concat_ws("-", h["start"].cast("string"), h["end"].cast("string"))), ","))


@query(f"WITH {POSTINGS_SQL}, f AS (SELECT {REF} FROM p WHERE lemma = 'worthless' GROUP BY ALL) SELECT f.corpus_id, f.book_ord, f.chapter, f.verse AS v_first, s.sentence AS content FROM f JOIN s USING ({REF}) ORDER BY book_ord, chapter, verse LIMIT 50")
def search_content_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = search.page(_hits(spark, sf_dir, "worthless", "all_terms"), 0, 50)
    keys = ["corpus_id", "book_ord", "chapter", "v_first"]
    # the page is cut before its content is joined; it has 50 rows at most
    return sentences(_docs(spark, sf_dir)).join(F.broadcast(page.select(*keys)), keys).select(*keys, F.col("text").alias("content"))


@query()
def segmentation_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in a script without blanks: each of 1,500 words, by the checksum of a Latin one, is one to three Han letters. How many words there are in each language, how many a
    vocabulary learned from the texts alone finds, and how many of these are right, from their first letter to their last."""
    letter = lambda k, j: zlib.crc32(f"{k}{j}".encode()) % 26
    made = ["".join(chr(start + letter(k, j)) for start, j in ((0x4E00, "a"), (0x4E80, "b"), (0x4F00, "c"))[: k % 3 + 1]) for k in range(1500)]
    han = F.split(F.lit(" ".join(made)), " ")
    words = F.transform(surface_array(F.col("text")), lambda w: F.get(han, (F.crc32(F.lower(w)) % 1500).cast("int")))
    texts = stored(sentences(_docs(spark, sf_dir)).select("corpus_id", words.alias("words")).where(F.size("words") > 0).withColumn("text", F.array_join("words", "")))
    cutter = segmentation.trained(texts, rounds=1)
    spans = lambda ws: set(itertools.pairwise((0, *itertools.accumulate(map(len, ws)))))

    @F.pandas_udf("struct<found: long, right: long>")
    def compare(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for written, joined in batches:
            cuts = [cutter.runs(t) for t in joined]
            yield pd.DataFrame({"found": [len(c) for c in cuts], "right": [len(spans(w) & spans(c)) for w, c in zip(written, cuts, strict=True)]})

    each = texts.select("corpus_id", F.size("words").alias("words"), compare("words", "text").alias("c"))
    return each.groupBy("corpus_id").agg(F.sum("words").alias("words"), F.sum("c.found").alias("found"), F.sum("c.right").alias("right"))


# Nodes and passages ---------------------------------------------------------------------------------------------------


@query("SELECT lang AS corpus_id, doc_id AS book_ord, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS chapters FROM documents")
def chapters_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_ops.chapter_list(nodes(_docs(spark, sf_dir))).groupBy("corpus_id", "book_ord").agg(F.count(F.lit(1)).alias("chapters"))


@query("SELECT lang AS corpus_id, doc_id AS book_ord, CAST(7 AS INTEGER) AS chapter FROM documents WHERE len(string_split(coalesce(text, ''), chr(10))) >= 7")
def has_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    wanted = docs.select(F.col("lang").alias("corpus_id"), F.col("doc_id").alias("book_ord"), F.lit(7).alias("chapter"))
    return node_ops.has_chapter(nodes(docs), wanted)


@query(f"WITH {SENTENCES_SQL}, n AS (SELECT corpus_id, book_ord, chapter, count(*) AS verses FROM s WHERE chapter = 2 GROUP BY ALL) SELECT corpus_id, book_ord, CAST(count(*) AS BIGINT) AS n_texts, string_agg(sentence, '' ORDER BY verse) AS content FROM s JOIN n USING (corpus_id, book_ord, chapter) WHERE verses >= 2 AND verse BETWEEN 2 AND 4 GROUP BY corpus_id, book_ord")
def passage_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    wanted = docs.select(F.col("doc_id").alias("req_id"), F.col("lang").alias("corpus_id"), F.col("doc_id").alias("book_ord"), F.lit(2).alias("chapter"), F.lit(2).alias("v_first"), F.lit(4).alias("v_last"))
    texts = passages.passage_nodes(nodes(docs), wanted).where("type = 'text'")
    parts = texts.groupBy("corpus_id", "book_ord").agg(F.count(F.lit(1)).alias("n_texts"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    return parts.select("corpus_id", "book_ord", "n_texts", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("content"))


@query(
    f"WITH {SENTENCES_SQL}, v AS (SELECT corpus_id, book_ord, chapter, verse AS place, 2 * verse - 1 AS a, 2 * verse AS b FROM s WHERE chapter = 1), "
    "f AS (SELECT corpus_id, book_ord, min(place) FILTER (WHERE a <= 3 AND 3 <= b) AS first, min(place) FILTER (WHERE a <= 4 AND 4 <= b) AS bridge FROM v GROUP BY ALL), "
    "e AS (SELECT f.corpus_id, f.book_ord, f.first, min(v.place) FILTER (WHERE v.a <= 5 AND 5 <= v.b) AS after FROM f JOIN v USING (corpus_id, book_ord) WHERE f.first IS NOT NULL GROUP BY ALL) "
    "SELECT corpus_id, book_ord, CAST(2 * (first - 1) AS INTEGER) AS start_inner, CAST(2 * (after - 1) AS INTEGER) AS end_inner FROM e"
)
def passage_end_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verse mark bridges two numbers; the passage of verse 3 ends after the bridge 3-4, at the mark that holds 5."""
    docs = _docs(spark, sf_dir)
    n = nodes(docs).where("chapter = 1")
    verse = F.col("type") == "verse"
    n = n.withColumns({"number_first": F.when(verse, F.col("v_first") * 2 - 1).otherwise(F.col("number_first")), "number_last": F.when(verse, F.col("v_last") * 2).otherwise(F.col("number_last"))})
    wanted = docs.select(F.col("doc_id").alias("req_id"), F.col("lang").alias("corpus_id"), F.col("doc_id").alias("book_ord"), F.lit(1).alias("chapter"), F.lit(3).alias("v_first"), F.lit(3).alias("v_last"))
    b = passages.bounds(n, wanted)
    return b.select("corpus_id", "book_ord", F.col("start_at.inner").alias("start_inner"), F.col("end_at.inner").alias("end_inner"))


# Books, names and references ------------------------------------------------------------------------------------------


@query("WITH o AS (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS pos FROM nation) SELECT n_regionkey AS group_id, CAST(pos AS INTEGER) AS pos, n_nationkey AS book_ord, lag(n_nationkey) OVER w AS predecessor, lead(n_nationkey) OVER w AS successor FROM o WINDOW w AS (PARTITION BY n_regionkey ORDER BY pos)")
def prev_next_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.neighbours(_nation_order(spark, sf_dir))


def _nation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name"))
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("group_id"), pos.alias("pos"), F.col("n_nationkey").alias("book_ord"))


@query("WITH o AS (SELECT n_nationkey, n_regionkey, n_name FROM nation) SELECT n_regionkey AS group_id, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_name) AS books FROM o GROUP BY n_regionkey")
def order_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.flat_order(_nation_order(spark, sf_dir)).select("group_id", F.array_join(F.transform("books", lambda b: b.cast("string")), ",").alias("books"))


@query("WITH o AS (SELECT n_nationkey, n_regionkey, n_name FROM nation) SELECT a.n_nationkey AS book_ord, coalesce(string_agg(CAST(b.n_nationkey AS VARCHAR), ',' ORDER BY b.n_name), '') AS successors FROM o a LEFT JOIN o b ON a.n_regionkey = b.n_regionkey AND b.n_name > a.n_name GROUP BY a.n_nationkey")
def successor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.successors(_nation_order(spark, sf_dir)).select("book_ord", F.array_join(F.transform("successors", lambda b: b.cast("string")), ",").alias("successors"))


@query(
    lambda: (
        "WITH "
        + dim_sql(load())
        + ", there AS (SELECT lang AS corpus_id, CAST(doc_id % 66 AS INTEGER) AS book_ord, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INTEGER) AS chapter FROM documents GROUP BY ALL), "
        "ok AS (SELECT t.* FROM there t JOIN dim ON ord = book_ord WHERE chapter <= len(counts)), "
        "asked AS (SELECT CAST(o_orderkey AS BIGINT) AS req_id, 'en' AS corpus_id, CAST(o_custkey % 66 AS INTEGER) AS book_ord, CAST(o_orderkey % 20 + 1 AS INTEGER) AS chapter FROM orders) "
        ", k AS (SELECT DISTINCT book_ord, chapter FROM asked) "
        ", a AS (SELECT k.book_ord, k.chapter, (SELECT max(o.book_ord * 1000 + o.chapter) FROM ok o WHERE o.corpus_id = 'en' AND o.book_ord * 1000 + o.chapter < k.book_ord * 1000 + k.chapter) AS p, (SELECT min(o.book_ord * 1000 + o.chapter) FROM ok o WHERE o.corpus_id = 'en' AND o.book_ord * 1000 + o.chapter > k.book_ord * 1000 + k.chapter) AS n FROM k) "
        "SELECT req_id, CAST(p AS INTEGER) AS previous_chapter, CAST(n AS INTEGER) AS next_chapter FROM asked JOIN a USING (book_ord, chapter)"
    )
)
def prev_next_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that exist stand for books by document; orders ask for chapters that may not exist."""
    docs = _docs(spark, sf_dir)
    there = docs.select(F.col("lang").alias("corpus_id"), (F.col("doc_id") % 66).cast("int").alias("book_ord"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("number")).distinct()
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("req_id"), F.lit("en").alias("corpus_id"), (F.col("o_custkey") % 66).cast("int").alias("book_ord"), (F.col("o_orderkey") % 20 + 1).cast("int").alias("chapter"))
    near = navigation.adjacent_chapters(there, asked, navigation.book_order(spark))
    code = lambda c: (F.col(f"{c}.book_ord") * 1000 + F.col(f"{c}.chapter")).alias(c)
    return near.select("req_id", code("previous_chapter"), code("next_chapter"))


_ALIAS_SQL = "a AS (SELECT lower(n_name) AS alias_key, CAST(n_nationkey + 100 AS INTEGER) AS book_ord, 0 AS pr, 'config' AS source FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT lower(n_name), CAST(n_nationkey AS INTEGER), 1, 'document' FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT lower(n_name), CAST(n_regionkey AS INTEGER), 2, 'built-in' FROM nation UNION ALL SELECT lower(r_name), CAST(r_regionkey AS INTEGER), 2, 'built-in' FROM region)"


@query(f"WITH {_ALIAS_SQL} SELECT 'x' AS corpus_id, alias_key, arg_min(book_ord, pr * 1000 + book_ord) AS book_ord, arg_min(source, pr * 1000 + book_ord) AS source FROM a GROUP BY alias_key")
def alias_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    own = lambda df, name, key: df.select(F.lit("x").alias("corpus_id"), F.lower(name).alias("alias_key"), F.col(key).cast("int").alias("book_ord"))
    config = own(nation.where("n_nationkey % 2 = 0").withColumn("k", F.col("n_nationkey") + 100), "n_name", "k")
    return aliases.cascade(config, own(nation.where("n_nationkey % 3 = 0"), "n_name", "n_nationkey"), own(nation, "n_name", "n_regionkey").union(own(region, "r_name", "r_regionkey")))


@query("SELECT r_name || n_name || o AS alias FROM region, nation, (VALUES ('1'), ('1st'), ('I')) t(o)")
def alias_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [table(spark, sf_dir, "region").select(F.col("r_name").alias("value")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")), spark.createDataFrame([("1",), ("1st",), ("I",)], "value string")]
    return aliases.permutations(names)


@query(lambda: f"WITH {dim_sql(load())} SELECT category, count(*) AS books, CAST(sum(len(counts)) AS BIGINT) AS chapters, CAST(sum(coalesce(list_sum(counts), 0)) AS BIGINT) AS verses FROM dim GROUP BY category")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = load().frame(spark)
    verses = F.aggregate("verse_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return dim.groupBy("category").agg(F.count(F.lit(1)).alias("books"), F.sum("chapter_count").cast("long").alias("chapters"), F.sum(verses).alias("verses"))


@query(lambda: f"WITH {dim_sql(load())} SELECT l_orderkey, l_linenumber, usfm_id, CAST(l_suppkey % 60 + 1 AS INTEGER) AS chapter, CAST(l_partkey % 40 + 1 AS INTEGER) AS verse, CASE WHEN l_suppkey % 60 + 1 > len(counts) THEN 'out_of_bounds_chapter' WHEN l_partkey % 40 + 1 > counts[CAST(l_suppkey % 60 + 1 AS INTEGER)] THEN 'out_of_bounds_verse' END AS error_type FROM lineitem JOIN dim ON ord = l_orderkey % 98")
def bounds_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = F.broadcast(load().frame(spark).select("ord", "usfm_id", "chapter_count", "verse_counts"))  # 113 books
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 98).cast("int").alias("ord"), (F.col("l_suppkey") % 60 + 1).cast("int").alias("chapter"), (F.col("l_partkey") % 40 + 1).cast("int").alias("verse"))
    verses = F.get("verse_counts", F.col("chapter") - 1)
    error = F.when(F.col("chapter") > F.col("chapter_count"), "out_of_bounds_chapter").when(F.col("verse") > verses, "out_of_bounds_verse")
    return rows.join(dim, "ord").select("l_orderkey", "l_linenumber", "usfm_id", "chapter", "verse", error.alias("error_type"))


@query(lambda: f"WITH {dim_sql(load())} SELECT o_orderkey, 0 AS book_ord, CASE WHEN e IS NULL THEN c END AS chapter, CASE WHEN e IS NULL THEN v END AS v_first, CASE WHEN e IS NULL THEN v END AS v_last, e AS error_type FROM (SELECT o_orderkey, c, v, CASE WHEN c > len(counts) THEN 'out_of_bounds_chapter' WHEN v > counts[c] THEN 'out_of_bounds_verse' END AS e FROM (SELECT o_orderkey, CAST(o_orderkey % 60 + 1 AS INTEGER) AS c, CAST(o_custkey % 40 + 1 AS INTEGER) AS v FROM orders) JOIN dim ON ord = 0) WHERE e IS NULL UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, CASE WHEN c > len(counts) THEN 'out_of_bounds_chapter' ELSE 'out_of_bounds_verse' END FROM (SELECT o_orderkey, CAST(o_orderkey % 60 + 1 AS INTEGER) AS c, CAST(o_custkey % 40 + 1 AS INTEGER) AS v FROM orders) JOIN dim ON ord = 0 WHERE c > len(counts) OR v > counts[c]")
def reference_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed references of one book, some out of bounds, through the full grammar."""
    text = F.concat(F.lit("Genesis "), (F.col("o_orderkey") % 60 + 1).cast("string"), F.lit(":"), (F.col("o_custkey") % 40 + 1).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(parse_column(text)).alias("r"))
    return rows.select("o_orderkey", "r.book_ord", "r.chapter", "r.v_first", "r.v_last", "r.error_type")


# Codes and links ------------------------------------------------------------------------------------------------------

_B59 = f"'{codec.ALPHABET}'"
_ENCODE = " || ".join(f"{_B59}[CAST((n // {59**k}) % 59 AS INTEGER) + 1]" for k in range(5, -1, -1))


@query(f"SELECT o_orderkey, CASE WHEN n = 0 THEN '1' ELSE ltrim({_ENCODE}, '0') END AS code FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 7919 + o_custkey AS n FROM orders)")
def base59_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey").cast("long") * 7919 + F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", codec.base59_encode_column(n).alias("code"))


@query("SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 7919 + o_custkey AS number FROM orders")
def base59_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with look-alike letters, decoded to what they were made from."""
    return base59_encode(spark, sf_dir).select("o_orderkey", codec.base59_decode_column(F.translate("code", "01", "OI")).alias("number"))


# Notes ----------------------------------------------------------------------------------------------------------------

#: lemma, lowest and highest reference (book, chapter, first, last), priority, note.
RULES = (("worthless", (0, 0, 0, 0), (10**9, 0, 0, 0), 0, "any"), ("worthless", (100, 0, 0, 0), (600, 10, 0, 0), 1, "middle"), ("idiot", (50, 1, 1, 1), (700, 3, 2, 2), 2, "some"), ("moron", (10, 0, 0, 0), (10**9, 0, 0, 0), 3, "late"))


def _rules(spark: SparkSession) -> DataFrame:
    ref = "struct<book_ord: bigint, chapter: int, v_first: int, v_last: int>"
    return spark.createDataFrame(list(RULES), f"lemma string, low {ref}, high {ref}, priority int, note string")


_RULES_SQL = ", ".join(f"('{w}', {a}, {b}, {p}, '{n}')" for w, a, b, p, n in RULES)
_MET_SQL = f"WITH {POSTINGS_SQL}, r(lemma, low, high, priority, note) AS (VALUES {_RULES_SQL}), m AS (SELECT p.corpus_id, p.lemma, p.book_ord, p.chapter, p.verse, p.pos, arg_max(note, priority) AS note FROM p JOIN r ON p.lemma = r.lemma AND (p.book_ord, p.chapter, p.verse, p.verse) >= low AND (p.book_ord, p.chapter, p.verse, p.verse) <= high GROUP BY ALL)"


@query(f"{_MET_SQL} SELECT note, lemma, count(*) AS n FROM m GROUP BY note, lemma")
def interval_rule_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = intervals.holding(postings(_docs(spark, sf_dir), {r[0] for r in RULES}).select("lemma", *intervals.AXES), _rules(spark), ["lemma"])
    return met.groupBy("note", "lemma").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_MET_SQL} SELECT corpus_id, book_ord, lemma, note, chapter, verse AS v_first FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id, book_ord, lemma, note ORDER BY chapter, verse, pos) AS k FROM m) WHERE k = 1")
def footnote_single_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = footnotes.single_word_notes(postings(_docs(spark, sf_dir), {r[0] for r in RULES}), _rules(spark))
    return found.select("corpus_id", "book_ord", "lemma", "note", "chapter", "v_first")


#: Words that rules made of orders name, by the key of the order.
ORDER_WORDS = ("the", "of", "and", "in", "der", "die", "und", "de", "la", "el", "worthless", "idiot", "moron")
_PLACE = "(CAST({b} AS HUGEINT) * 100000 + {c}) * 100000 + {v}"


@query(
    f"WITH {POSTINGS_SQL}, r AS (SELECT {list(ORDER_WORDS)}[CAST(o_orderkey % {len(ORDER_WORDS)} AS INTEGER) + 1] AS lemma, o_orderkey AS note, "
    f"{_PLACE.format(b='o_custkey', c='o_orderkey % 7', v='o_orderkey % 5')} AS low, {_PLACE.format(b='(o_custkey + o_orderkey % 3)', c='o_orderkey % 11', v='o_orderkey % 6')} AS high FROM orders), "
    f"m AS (SELECT p.lemma, {_PLACE.format(b='p.book_ord', c='p.chapter', v='p.verse')} AS at, count(*) AS n FROM p WHERE lemma IN {ORDER_WORDS} GROUP BY ALL) "
    "SELECT lemma, CAST(note AS BIGINT) AS rule, CAST(sum(n) AS BIGINT) AS n FROM (SELECT m.lemma, m.at, any_value(m.n) AS n, max(r.note) AS note FROM m JOIN r ON m.lemma = r.lemma AND m.at BETWEEN r.low AND r.high GROUP BY m.lemma, m.at) GROUP BY lemma, note"
)
def interval_rules_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each order: spans of one to three documents; which rule counts for how many words."""
    key = F.col("o_orderkey")
    end = lambda book, chapter, verse: F.struct(book.alias("book_ord"), (key % chapter).alias("chapter"), (key % verse).alias("v_first"), (key % verse).alias("v_last"))
    word = F.element_at(F.array(*[F.lit(w) for w in ORDER_WORDS]), (key % len(ORDER_WORDS)).cast("int") + 1)
    rules = table(spark, sf_dir, "orders").select(word.alias("lemma"), end(F.col("o_custkey"), 7, 5).alias("low"), end(F.col("o_custkey") + key % 3, 11, 6).alias("high"), key.alias("priority"), key.cast("string").alias("note"))
    met = intervals.holding(postings(_docs(spark, sf_dir), ORDER_WORDS).select("lemma", *intervals.AXES), rules, ["lemma"])
    return met.groupBy("lemma", F.col("priority").cast("long").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


PHRASES = ("of the", "of the and", "the and", "in the", "de la", "und die")


def _phrase_sql(stretches: str, phrases: tuple[str, ...]) -> str:
    """told (r, k, size, phrase): the phrases told in stretches (r, k, word, n), k from 1 to n; three words at most in each."""
    return f"""wd AS ({stretches}),
ph(phrase) AS (VALUES {", ".join(f"('{p}')" for p in phrases)}),
pw AS (SELECT phrase, string_split(phrase, ' ') AS ws FROM ph),
bg AS (SELECT DISTINCT ws[:i] AS ws FROM (SELECT ws, unnest(range(1, len(ws) + 1)) AS i FROM pw)),
x AS (SELECT r, k, n, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM wd WINDOW o AS (PARTITION BY r ORDER BY k)),
one AS (SELECT r, k, n, CASE WHEN k + 2 <= n AND [word, w2, w3] IN (SELECT ws FROM bg) THEN 3 WHEN k + 1 <= n AND [word, w2] IN (SELECT ws FROM bg) THEN 2 WHEN [word] IN (SELECT ws FROM bg) THEN 1 ELSE 0 END AS size, [word, w2, w3] AS ws FROM x),
runs AS (SELECT *, coalesce(max(k + size) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= k AS free FROM one WHERE size > 0),
go AS (SELECT r, k, size FROM runs WHERE free UNION ALL SELECT t.r, t.k, t.size FROM go JOIN runs t ON t.r = go.r AND t.k = (SELECT min(u.k) FROM runs u WHERE u.r = go.r AND u.k >= go.k + go.size) AND NOT t.free),
run AS (SELECT go.r, go.k, go.size, ws[:go.size] AS ws, go.k + go.size <= n AS more FROM go JOIN one USING (r, k)),
told AS (SELECT r, CASE WHEN whole THEN k ELSE k + size - rest END AS k, CASE WHEN whole THEN size ELSE rest END AS size, array_to_string(CASE WHEN whole THEN ws ELSE ws[size - rest + 1:] END, ' ') AS phrase
  FROM (SELECT *, ws IN (SELECT ws FROM pw) AS whole, CASE WHEN NOT more THEN 0 WHEN size = 3 AND ws[2:] IN (SELECT ws FROM bg) THEN CASE WHEN ws[2:] IN (SELECT ws FROM pw) THEN 2 ELSE 0 END WHEN size >= 2 AND ws[size:] IN (SELECT ws FROM bg) AND ws[size:] IN (SELECT ws FROM pw) THEN 1 ELSE 0 END AS rest FROM run)
  WHERE whole OR rest > 0)"""


def _phrases(spark: SparkSession, names: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(p.split(),) for p in names], "phrase array<string>")


_WHOLE_TEXTS = r"SELECT doc_id AS r, unnest(ws) AS word, generate_subscripts(ws, 1) AS k, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*') AS ws FROM documents)"


@query(f"WITH RECURSIVE {_phrase_sql(_WHOLE_TEXTS, PHRASES)} SELECT r AS doc_id, phrase, count(*) AS n FROM told GROUP BY ALL")
def footnote_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of six phrases is told in each document, longest phrases first; a whole text is one stretch."""
    words = spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", surface_array(F.coalesce("text", F.lit(""))).alias("ws"))
    each = words.select("doc_id", (F.size("ws") - 1).alias("last_pos"), F.posexplode("ws").alias("pos", "surface")).select("doc_id", "pos", "last_pos", lemma_column(F.col("surface")).alias("lemma"))
    return phrases.told(each, _phrases(spark, PHRASES), ["doc_id"]).groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("n"))


#: phrase, lowest and highest reference, priority, note: a later rule hides an earlier one in a part of its span, and a phrase without a rule at a place hides the shorter one in it.
PHRASE_RULES = (("of the", (0, 0, 0, 0), (10**9, 0, 0, 0), 0, "any"), ("of the", (100, 1, 2, 2), (600, 4, 9, 9), 1, "middle"), ("the and", (0, 0, 0, 0), (10**9, 0, 0, 0), 2, "pair"), ("of the and", (200, 0, 0, 0), (300, 0, 0, 0), 3, "long"), ("de la", (50, 1, 1, 1), (50, 9, 9, 9), 4, "one"))
_VERSE_STRETCHES = "SELECT (corpus_id, book_ord, chapter, verse) AS r, lemma AS word, pos AS k, count(*) OVER (PARTITION BY corpus_id, book_ord, chapter, verse) AS n FROM p"


@query(
    f"WITH RECURSIVE {POSTINGS_SQL}, {_phrase_sql(_VERSE_STRETCHES, tuple(dict.fromkeys(r[0] for r in PHRASE_RULES)))}, "
    f"r(phrase, low, high, priority, note) AS (VALUES {', '.join(f"('{w}', {a}, {b}, {p}, '{n}')" for w, a, b, p, n in PHRASE_RULES)}), "
    "m AS (SELECT t.r[1] AS corpus_id, t.r[2] AS book_ord, t.r[3] AS chapter, t.r[4] AS verse, t.k, phrase, arg_max(note, priority) AS note FROM told t JOIN r USING (phrase) WHERE (t.r[2], t.r[3], t.r[4], t.r[4]) >= low AND (t.r[2], t.r[3], t.r[4], t.r[4]) <= high GROUP BY ALL) "
    "SELECT corpus_id, book_ord, phrase, note, CAST(chapter AS INTEGER) AS chapter, CAST(verse AS INTEGER) AS v_first, CAST(k - 1 AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id, book_ord, phrase, note ORDER BY chapter, verse, k) AS first FROM m) WHERE first = 1"
)
def footnote_phrase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each phrase's note goes: the first verse of a document in which it is told and the rule holds; verses are stretches."""
    ref = "struct<book_ord: bigint, chapter: int, v_first: int, v_last: int>"
    rules = spark.createDataFrame(list(PHRASE_RULES), f"phrase string, low {ref}, high {ref}, priority int, note string")
    s = sentences(_docs(spark, sf_dir), {w for r in PHRASE_RULES for w in r[0].split(" ")}).select("corpus_id", "book_ord", "chapter", "v_first", "v_last", surface_array(F.col("text")).alias("ws"))
    keys = ["corpus_id", "book_ord", "chapter", "v_first", "v_last"]
    each = s.select(*keys, (F.size("ws") - 1).alias("last_pos"), F.posexplode("ws").alias("pos", "surface")).select(*keys, "pos", "last_pos", lemma_column(F.col("surface")).alias("lemma"))
    found = phrases.told(each, _phrases(spark, tuple(r[0] for r in PHRASE_RULES)), keys)
    first = phrases.notes(found, rules, ["corpus_id", "book_ord"], ["chapter", "v_first", "pos"])
    return first.select("corpus_id", "book_ord", "phrase", "note", "chapter", "v_first", "pos")


# Labels, markup, JSON -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN k <= 26 THEN chr(CAST(96 + k AS INTEGER)) WHEN k <= 702 THEN chr(CAST(96 + (k - 1) // 26 AS INTEGER)) || chr(CAST(97 + (k - 1) % 26 AS INTEGER)) ELSE chr(CAST(96 + (k - 27) // 676 AS INTEGER)) || chr(CAST(97 + ((k - 27) // 26) % 26 AS INTEGER)) || chr(CAST(97 + (k - 1) % 26 AS INTEGER)) END AS label FROM (SELECT p_partkey, p_partkey % 5000 + 1 AS k FROM part)")
def note_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", markers.alpha_label(F.col("p_partkey") % 5000 + 1).alias("label"))


@query("SELECT lang, count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM documents GROUP BY lang")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / 50).cast("long").alias("pages"))


@query(r"SELECT doc_id, CASE WHEN l = '' THEN NULL WHEN regexp_matches(l, '[\p{Hebrew}\p{Arabic}\p{Syriac}\p{Thaana}\p{Nko}]') THEN 'rtl' ELSE 'ltr' END AS direction FROM (SELECT doc_id, regexp_extract(coalesce(text, ''), '(\p{L})', 1) AS l FROM documents)")
def text_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", markers.text_direction(F.coalesce("text", F.lit(""))).alias("direction"))


@query(r"SELECT CASE WHEN r LIKE '%.%' THEN regexp_extract(lower(r), '\.([^.]+)$', 1) ELSE '' END AS extension, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') AS r FROM pages) GROUP BY 1")
def extension_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import extension

    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]*", "")
    return table(spark, sf_dir, "pages").groupBy(extension(path).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}][\\p{L}\\p{N}\\p{M}]*')) AS INTEGER) AS words, CAST(len(list_distinct(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+'))) AS INTEGER) AS lemmas FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _docs(spark, sf_dir).select("doc_id", F.size(surface_array(text)).alias("words"), F.size(F.array_distinct(word_array(text))).alias("lemmas"))


# Streaming ------------------------------------------------------------------------------------------------------------


@query(SQL["postings_count_by_lang"])
def stream_postings_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of documents as they arrive: each micro-batch writes its counts under its own id, so that a repeated batch replaces itself."""
    folder = scratch(spark)
    stream = spark.readStream.schema(_docs(spark, sf_dir).schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/documents.parquet*")

    def write(batch: DataFrame, number: int) -> None:
        postings(batch).groupBy("corpus_id", "lemma").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    counts = spark.read.schema("corpus_id string, lemma string, n long, batch int").parquet(f"{folder}/counts").groupBy("corpus_id", "lemma").agg(F.sum("n").alias("n"))
    return counts.groupBy("corpus_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_lemmas"))
