"""Queries that run the readers, the nodes, the real index and the engine on documents of the tables, each with the SQL that says the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, markers, references
from ..functions.catalog import load
from ..functions.normalize import normalize_column
from ..functions.references import Reference, parse_column
from ..functions.tokens import lemma_column, lemmas, run_array, surface_array
from ..operators import aliases, display, index, links, navigation, passages, search
from ..operators import nodes as node_ops
from ..session import passing, scratch, shuffles_dropped, stored
from ..sources.snapshot import deal, read_snapshot, write_snapshot
from ..sources.usj_variant import parse_marker, parse_trees, verse_range
from .adapter import sentences, table
from .corpus import CORPUS_SQL, HEADED, NAMES, corpus_nodes, files, sole, usfm_files
from .registry import dim_sql, query

# Reading --------------------------------------------------------------------------------------------------------------

_NAMED = ", ".join(f"'{m}', {k}" for m, k in NAMES.items())
_HEADS = " + ".join(f"count(*) FILTER (WHERE doc_id % {k} = 0)" for k in NAMES.values())


@query(
    f"{CORPUS_SQL}, {HEADED}, c AS (SELECT (SELECT count(*) FROM d) AS docs, (SELECT {_HEADS} FROM d) AS heads, (SELECT count(*) FROM l) AS lines, (SELECT count(*) FROM h) AS headings, (SELECT count(*) FROM s) AS verses, (SELECT count(*) FROM s WHERE nth % 4 = 0) AS notes) "
    "SELECT t.type, CAST(t.n AS BIGINT) AS n FROM c, LATERAL (VALUES ('USJ', docs), ('book', docs), ('chapter', lines), ('para', lines + 2 * headings + heads), ('verse', verses), ('note', notes), ('char', notes), ('text', docs + heads + headings + verses + notes)) t(type, n)"
)
def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON trees read, checked and flattened."""
    return corpus_nodes(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"{CORPUS_SQL}, {HEADED}, r AS (SELECT corpus_id, book_ord, chapter AS n, 'chapter' AS type, 1 AS depth FROM l UNION ALL SELECT corpus_id, book_ord, verse, 'verse', 2 FROM s UNION ALL SELECT corpus_id, book_ord, length(sentence), 'text', 2 FROM s UNION ALL SELECT corpus_id, book_ord, 3, 'text', 4 FROM s WHERE nth % 4 = 0 UNION ALL SELECT corpus_id, book_ord, 7, 'text', 2 FROM h) "
    "SELECT corpus_id, book_ord, type, CAST(depth AS INTEGER) AS depth, count(*) AS n, CAST(sum(n) AS BIGINT) AS total FROM r GROUP BY ALL"
)
def document_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON trees walked in the JVM: chapters, verses and texts by depth, with the sums of their numbers and lengths."""
    n = node_ops.nodes(stored(parse_trees(files(table(spark, sf_dir, "documents"), sole()))))
    kept = n.where("type in ('chapter', 'verse') or type = 'text' and chapter is not null")
    number = F.when(F.col("type") == "text", F.length("text")).otherwise(F.col("number_first"))
    return kept.groupBy("corpus_id", "book_ord", "type", "depth").agg(F.count(F.lit(1)).alias("n"), F.sum(number).cast("long").alias("total"))


@query(
    "WITH d AS (SELECT string_split(translate(coalesce(text, ''), '\\|~/', ''), chr(10)) AS ls FROM documents), l AS (SELECT unnest(ls) AS line FROM d), s AS (SELECT unnest(regexp_extract_all(line, '[^.!?]+[.!?]*')) AS sentence FROM l) "
    "SELECT (SELECT count(*) FROM l) AS chapters, count(*) AS verses, CAST(sum(length(regexp_replace(sentence, '\\s', '', 'g'))) AS BIGINT) AS letters FROM s"
)
def usfm_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents in the marker text format."""
    n = node_ops.nodes(node_ops.parse_files(usfm_files(table(spark, sf_dir, "documents"))))
    verse_text = (F.col("type") == "text") & F.col("v_first").isNotNull()
    letters = F.sum(F.when(verse_text, F.length(F.regexp_replace("text", r"\s", "")))).cast("long")
    return n.agg(F.count(F.when(F.col("type") == "chapter", 1)).alias("chapters"), F.count(F.when(F.col("type") == "verse", 1)).alias("verses"), letters.alias("letters"))


@query("SELECT doc_id, lang AS corpus_id, CAST(doc_id % 66 AS INTEGER) AS book_ord, row_number() OVER (PARTITION BY lang, doc_id % 66 ORDER BY doc_id) > 1 AS ignored FROM documents")
def duplicate_source_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as corpora: many files are the same book, and the first path counts."""
    found = node_ops.books_of(node_ops.parse_books(files(table(spark, sf_dir, "documents"), F.col("lang"))))
    return found.select(F.regexp_extract("path_name", r"^0*(\d+)\.", 1).cast("long").alias("doc_id"), "corpus_id", "book_ord", "ignored")


@query(f"{CORPUS_SQL} SELECT corpus_id, book_ord, chapter, verse AS v_first, verse AS v_last, count(*) + count(*) FILTER (WHERE nth % 4 = 0) + count(*) FILTER (WHERE nth = 3 AND parted) AS texts FROM s GROUP BY ALL")
def carry_forward_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapter and verse that hold at each text: in paragraphs, notes and headings."""
    n = corpus_nodes(spark, sf_dir).where("type = 'text' and v_first is not null")
    return n.groupBy("corpus_id", "book_ord", "chapter", "v_first", "v_last").agg(F.count(F.lit(1)).alias("texts"))


@query(f"{CORPUS_SQL}, {HEADED} SELECT t.marker AS marker, CAST(t.n AS BIGINT) AS n FROM (SELECT (SELECT count(*) FROM d) AS docs, (SELECT count(*) FROM l) AS lines, (SELECT count(*) FROM h) AS headings, (SELECT count(*) FROM s) AS verses, (SELECT count(*) FROM s WHERE nth % 4 = 0) AS notes, " + ", ".join(f"(SELECT count(*) FROM d WHERE doc_id % {k} = 0) AS {m}" for m, k in NAMES.items()) + ") c, LATERAL (VALUES ('USJ', docs), ('id', docs), ('c', lines), ('p', lines + headings), ('s1', headings), ('v', verses), ('f', notes), ('ft', notes), " + ", ".join(f"('{m}', {m})" for m in NAMES) + ") t(marker, n)")
def marker_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = node_ops.marker_histogram(corpus_nodes(spark, sf_dir))
    return h.groupBy(F.col("marker_or_type").alias("marker")).agg(F.sum("n").alias("n"))


@query(f"{CORPUS_SQL}, {HEADED}, x AS (SELECT corpus_id, book_ord, chapter, 1 AS n FROM h UNION ALL SELECT corpus_id, book_ord, chapter, 2 FROM s WHERE nth % 4 = 0) SELECT corpus_id, book_ord, chapter, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY ALL")
def unsupported_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_ops.unsupported(corpus_nodes(spark, sf_dir), ["USJ", "id", "c", "v", "p", *NAMES])


@query(f"{CORPUS_SQL}, n AS (SELECT corpus_id, book_ord, row_number() OVER (PARTITION BY corpus_id, book_ord ORDER BY line, nth) AS note_no FROM s WHERE nth % 4 = 0) SELECT corpus_id, book_ord, CAST(note_no AS INTEGER) AS note_no, CASE WHEN note_no <= 26 THEN chr(CAST(96 + note_no AS INTEGER)) WHEN note_no <= 702 THEN chr(CAST(96 + (note_no - 1) // 26 AS INTEGER)) || chr(CAST(97 + (note_no - 1) % 26 AS INTEGER)) ELSE chr(CAST(96 + (note_no - 27) // 676 AS INTEGER)) || chr(CAST(97 + ((note_no - 27) // 26) % 26 AS INTEGER)) || chr(CAST(97 + (note_no - 1) % 26 AS INTEGER)) END AS label FROM n")
def note_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_ops.note_labels(corpus_nodes(spark, sf_dir)).select("corpus_id", "book_ord", "note_no", "label")


# Books and names ------------------------------------------------------------------------------------------------------


@query(lambda: f"{CORPUS_SQL}, {dim_sql(load())} SELECT corpus_id, book_ord, usfm_id AS code, 'about ' || doc_id AS description FROM d JOIN dim ON ord = book_ord")
def book_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_ops.book_info(corpus_nodes(spark, sf_dir))


_NAMES_SQL = ", ".join(f"CASE WHEN doc_id % {NAMES[m]} = 0 THEN '{m} É' || doc_id END AS {k}" for m, k in node_ops.NAME_MARKERS.items() if m in NAMES)


@query(lambda: f"{CORPUS_SQL}, {dim_sql(load())}, n AS (SELECT corpus_id, book_ord, {_NAMES_SQL} FROM d) SELECT corpus_id, book_ord, running_header, long, short, abbreviation, coalesce(short, running_header, abbreviation, long, usfm_id) AS simple_name FROM n JOIN dim ON ord = book_ord WHERE coalesce(running_header, long, short, abbreviation) IS NOT NULL")
def translated_info_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_ops.short_name(node_ops.translated_book_info(corpus_nodes(spark, sf_dir))).drop("usfm_id")


@query(f"{CORPUS_SQL}, n AS (SELECT corpus_id, book_ord, {_NAMES_SQL} FROM d), e AS (SELECT corpus_id, book_ord, unnest([running_header, long, short, abbreviation]) AS name FROM n) SELECT DISTINCT corpus_id, book_ord, strip_accents(lower(replace(name, ' ', ''))) AS alias_key, 'document' AS source FROM e WHERE name IS NOT NULL")
def book_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_ops.names(node_ops.translated_book_info(corpus_nodes(spark, sf_dir)))


@query(f"{CORPUS_SQL} SELECT corpus_id, 'H  e\u0301' || doc_id AS name, CASE WHEN doc_id % 2 = 0 THEN book_ord END AS book_ord FROM d")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books asked for by the names in their documents, in another case and with decomposed marks; some documents do not name themselves."""
    n = corpus_nodes(spark, sf_dir)
    known = node_ops.names(node_ops.translated_book_info(n))
    asked = table(spark, sf_dir, "documents").select(sole().alias("corpus_id"), F.concat(F.lit("H  e\u0301"), F.col("doc_id").cast("string")).alias("name"))
    return aliases.resolve(asked, known, n.where("type = 'book'")).select("corpus_id", "name", "book_ord")


@query(lambda: f"{CORPUS_SQL}, {dim_sql(load())} SELECT corpus_id, bool_or(category = 'OT') AS has_ot, bool_or(category = 'NT') AS has_nt, bool_or(category = 'AP') AS has_ap, count(*) AS books FROM d JOIN dim ON ord = book_ord GROUP BY corpus_id")
def testaments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts of the canon each corpus has."""
    dim = F.broadcast(load().frame(spark).select(F.col("ord").alias("book_ord"), "category"))  # 113 books
    books = corpus_nodes(spark, sf_dir).where("type = 'book'").select("corpus_id", "book_ord").join(dim, "book_ord")
    return books.groupBy("corpus_id").agg(*[F.bool_or(F.col("category") == c).alias(f"has_{c.lower()}") for c in ("OT", "NT", "AP")], F.count(F.lit(1)).alias("books"))


@query(r"SELECT p_partkey, strip_accents(lower(regexp_replace(p_name, '\s', '', 'g'))) || 'efi''よはねaeoud' AS alias_key FROM part")
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full normal form: marks, width, ligatures, kana, quotes, Vietnamese."""
    return table(spark, sf_dir, "part").select("p_partkey", normalize_column(F.concat("p_name", F.lit(" E\u0301 ﬁ’ ヨハネ Æ Ơ ư Đ"))).alias("alias_key"))


# Index and search -----------------------------------------------------------------------------------------------------


@query(f"{CORPUS_SQL} SELECT corpus_id, lemma, count(*) AS total, coalesce(arg_min(surface, struct_pack(a := book_ord, b := line, c := nth, d := k)) FILTER (WHERE surface <> lemma), lemma) AS name FROM w GROUP BY corpus_id, lemma")
def index_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the real index over real nodes."""
    return index.vocabulary(index.words(corpus_nodes(spark, sf_dir)))


@query(f"{CORPUS_SQL} SELECT corpus_id, book_ord, line AS root_no, nth AS verse_no, trim(sentence) AS text FROM s")
def segment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each stretch between verse marks; notes and headings are not in it. Lines are numbered by the chapters before."""
    n = corpus_nodes(spark, sf_dir)
    segs = index.segments(n).select("corpus_id", "book_ord", "segment", "text")
    sofar = Window.partitionBy("corpus_id", "book_ord").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("type")
    marks = n.where("type in ('chapter', 'verse') or type = 'text' and is_index and in_para and v_first is not null").select("corpus_id", "book_ord", "seq", "type")
    marks = marks.withColumns({"root_no": F.count(F.when(kind == "chapter", 1)).over(sofar), "verses": F.count(F.when(kind == "verse", 1)).over(sofar)})
    # the same order serves: verses before the chapter are taken off
    verse_no = F.col("verses") - F.coalesce(F.max(F.when(kind == "chapter", F.col("verses"))).over(sofar), F.lit(0))
    marks = marks.withColumn("verse_no", verse_no).where("type = 'text'").select("corpus_id", "book_ord", F.col("seq").alias("segment"), "root_no", "verse_no")
    return segs.join(marks, ["corpus_id", "book_ord", "segment"]).select("corpus_id", "book_ord", "root_no", "verse_no", F.trim("text").alias("text"))


#: Words with marks, as they stand in texts of three languages, composed and decomposed.
ACCENTED = ("für", "está", "e\u0301te\u0301")


@query(f"{CORPUS_SQL}, q(lemma) AS (VALUES ('fur'), ('esta'), ('ete')) SELECT corpus_id, book_ord, chapter, verse AS v_first, verse AS v_last, lemma, count(*) AS occurrences FROM w JOIN q USING (lemma) GROUP BY ALL")
def search_accented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accented words, looked up one by one in the real index, written once: one lemma serves texts and queries."""
    path = scratch(spark)
    words = index.words(corpus_nodes(spark, sf_dir)).select("corpus_id", "lemma", *index.REF).sortWithinPartitions("lemma")
    with shuffles_dropped(spark):
        words.write.parquet(path)
    p = spark.read.parquet(path)
    out = None
    for word in ACCENTED:
        found = search.hits(p, search.query_frame(spark, word), "all_terms").withColumn("lemma", F.lit(lemmas(word)[0]))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"{CORPUS_SQL} SELECT corpus_id, count(*) AS postings, count(DISTINCT lemma) AS lemmas FROM w GROUP BY corpus_id")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and postings written as a snapshot and read back."""
    path = scratch(spark)
    with passing(spark):
        n = corpus_nodes(spark, sf_dir)
        write_snapshot(path, n, index.postings(n, deal=deal()), {"x": "display_name = 'X'"})
    _, p, configs = read_snapshot(spark, path)
    assert configs == {"x": "display_name = 'X'"}
    return p.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("postings"), F.count_distinct("lemma").alias("lemmas"))


@query(f"{CORPUS_SQL} SELECT (SELECT count(*) FROM d) AS books, count(*) AS words FROM w")
def snapshot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a snapshot says of itself, counted while it is written."""
    with passing(spark):
        n = corpus_nodes(spark, sf_dir)
        counts = write_snapshot(scratch(spark), n, index.postings(n, deal=deal()), {})
    return spark.createDataFrame([(counts["books"], counts["words"])], "books long, words long")


# Display --------------------------------------------------------------------------------------------------------------


@query(f"{CORPUS_SQL}, {HEADED}, c AS (SELECT (SELECT count(*) FROM d) AS docs, (SELECT {_HEADS} FROM d) AS heads, (SELECT count(*) FROM l) AS lines, (SELECT count(*) FROM h) AS headings, (SELECT count(*) FROM s) AS verses) SELECT t.type, CAST(t.n AS BIGINT) AS n FROM c, LATERAL (VALUES ('USJ', docs), ('book', docs), ('para', lines + headings + heads), ('text', docs + heads + verses)) t(type, n)")
def display_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.shown(corpus_nodes(spark, sf_dir)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"{CORPUS_SQL}, r AS (SELECT doc_id, line, nth, unnest(rs) AS run, generate_subscripts(rs, 1) AS k FROM (SELECT *, regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}]*|[^\\p{{L}}\\p{{N}}]+') AS rs FROM s)), "
    "m AS (SELECT doc_id, line, nth, string_agg(CASE WHEN strip_accents(lower(run)) IN ('the', 'und') THEN '[' || run || ']' ELSE run END, '' ORDER BY k) AS shown, count(*) FILTER (WHERE strip_accents(lower(run)) IN ('the', 'und')) AS n FROM r GROUP BY ALL) SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(nth AS BIGINT) AS nth, shown FROM m WHERE n > 0"
)
def highlight_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with two words marked in them: the words are sought and marked row by row, without a shuffle."""
    words = ("the", "und")
    s = sentences(table(spark, sf_dir, "documents"), words)
    asked = lambda c: lemma_column(c).isin(*words)
    held = s.where(F.exists(surface_array(F.col("text")), asked))
    tokens = held.withColumn("tokens", index.tokens_column(run_array(F.col("text"))))
    places = F.transform(F.filter("tokens", lambda t: asked(t["surface"])), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    cut = tokens.withColumn("pieces", display.pieces_column(F.col("text"), places))
    shown = F.array_join(F.transform("pieces", lambda p: F.when(p["marked"], F.concat(F.lit("["), p["text"], F.lit("]"))).otherwise(p["text"])), "")
    return cut.select(F.col("book_ord").alias("doc_id"), F.col("chapter").cast("long").alias("line"), F.col("v_first").cast("long").alias("nth"), shown.alias("shown"))


@query("SELECT o_orderkey, 'Book ' || (o_custkey % 9 + 1) || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ':' || (o_custkey % 7 + 1) ELSE ':' || (o_custkey % 7 + 1) || '-' || (o_custkey % 7 + 4) END AS shown FROM orders")
def reference_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey") % 3, F.col("o_custkey")
    first = F.when(o != 0, c % 7 + 1)
    last = F.when(o == 1, c % 7 + 1).when(o == 2, c % 7 + 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", display.reference_text(F.lit("Book"), (c % 9 + 1).cast("string"), first, last).alias("shown"))


# Passages -------------------------------------------------------------------------------------------------------------

_ROOTS = "r AS (SELECT l.*, 1 + CAST(l.doc_id % 2 = 0 AS INTEGER) + CAST(l.doc_id % 3 = 0 AS INTEGER) + CAST(l.doc_id % 5 = 0 AS INTEGER) + CAST(l.doc_id % 7 = 0 AS INTEGER) + coalesce(sum(CASE WHEN line % 3 = 0 AND len(ss) > 3 THEN 4 ELSE 2 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chapter_root FROM l)"


@query(f"{CORPUS_SQL}, {_ROOTS} SELECT corpus_id, book_ord, CAST(chapter_root + 2 AS INTEGER) AS start_root, 0 AS start_inner FROM r WHERE line = 3 AND len(ss) > 3")
def passage_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage of the verse after a heading starts at the heading: verse 4 of the third chapter."""
    n = corpus_nodes(spark, sf_dir)
    wanted = n.where("type = 'book'").select(F.xxhash64("corpus_id", "book_ord").alias("req_id"), "corpus_id", "book_ord", F.lit(3).alias("chapter"), F.lit(4).alias("v_first"), F.lit(4).alias("v_last"))
    b = passages.bounds(n, wanted)
    return b.select("corpus_id", "book_ord", F.col("start_at.root").alias("start_root"), F.col("start_at.inner").alias("start_inner"))


@query(lambda: f"{CORPUS_SQL}, {dim_sql(load())}, x AS (SELECT corpus_id, book_ord, max(line) AS b FROM l GROUP BY ALL) SELECT corpus_id, book_ord, 1 AS before, CASE WHEN b >= 3 AND len(counts) >= 3 THEN 3 END AS after FROM x JOIN dim ON ord = book_ord WHERE b >= 2")
def chapter_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters before and after the second one, from the nodes; every book stands alone in its order."""
    n = corpus_nodes(spark, sf_dir)
    chapters = node_ops.chapter_list(n)
    wanted = chapters.where("number = 2").select("corpus_id", "book_ord").distinct().withColumns({"chapter": F.lit(2), "req_id": F.xxhash64("corpus_id", "book_ord")})
    order = navigation.book_order(spark, [[b.ord] for b in load().books])
    near = navigation.adjacent_chapters(chapters, wanted, order)
    return near.join(wanted.select("req_id", "corpus_id", "book_ord"), "req_id").select("corpus_id", "book_ord", F.col("previous_chapter.chapter").alias("before"), F.col("next_chapter.chapter").alias("after"))


# References, codes and links ------------------------------------------------------------------------------------------


@query(lambda: f"WITH {dim_sql(load())}, c AS (SELECT ord, unnest(counts) AS n, generate_subscripts(counts, 1) AS chapter FROM dim), v AS (SELECT ord, chapter, unnest(range(1, n + 1)) AS verse FROM c), w AS (SELECT CAST(ord AS BIGINT) * 1000000 + chapter * 1000 + verse AS code FROM v) SELECT code, lag(code) OVER (ORDER BY code) AS previous, lead(code) OVER (ORDER BY code) AS next FROM w")
def verse_ordinal_next_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verse before and after every verse of the canon."""
    known = load()

    @F.pandas_udf("array<long>")
    def near(codes: pd.Series) -> pd.Series:
        def one(code: int) -> list:
            r = Reference(int(code) // 1_000_000, int(code) // 1000 % 1000, int(code) % 1000, int(code) % 1000)
            out = []
            for by in (-1, 1):
                try:
                    x = references.step(r, by, known)
                    out.append(x.book * 1_000_000 + x.chapter * 1000 + x.first)
                except ValueError:
                    out.append(None)
            return out

        return codes.map(one)

    dim = known.frame(spark).select("ord", F.posexplode("verse_counts").alias("c", "n"))
    each = dim.select("ord", "c", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("verse"))
    code = F.col("ord").cast("long") * 1_000_000 + (F.col("c") + 1) * 1000 + F.col("verse")
    rows = each.select(code.alias("code")).withColumn("near", near("code"))
    return rows.select("code", F.col("near")[0].alias("previous"), F.col("near")[1].alias("next"))


_PARTS_SQL = "SELECT o_orderkey, usfm_id, counts, CAST(o_orderkey % 30 + 1 AS INTEGER) AS c1, CAST(o_custkey % 30 + 1 AS INTEGER) AS v1, CAST(o_custkey % 20 + 1 AS INTEGER) AS c2, CAST(o_orderkey % 25 + 1 AS INTEGER) AS v2, CAST(o_orderkey % 9 + 1 AS INTEGER) AS v3, CAST(o_custkey % 66 AS INTEGER) AS b FROM orders JOIN dim ON ord = o_custkey % 66"


@query(
    lambda: (
        f"WITH {dim_sql(load())}, o AS ({_PARTS_SQL}), p AS (SELECT o_orderkey, counts, b, 0 AS part_no, c1 AS c, v1 AS f, v1 AS t FROM o UNION ALL SELECT o_orderkey, counts, b, 1, c2, v2, v2 + 2 FROM o UNION ALL SELECT o_orderkey, counts, b, 2, c2, v3, v3 FROM o), "
        "e AS (SELECT *, CASE WHEN c > len(counts) THEN 'out_of_bounds_chapter' WHEN t > counts[c] THEN CASE WHEN part_no = 2 THEN 'unknown_book' ELSE 'out_of_bounds_verse' END END AS error FROM p) "
        "SELECT o_orderkey, CAST(part_no AS INTEGER) AS part_no, CASE WHEN error IS NULL THEN b END AS book_ord, CASE WHEN error IS NULL THEN c END AS chapter, CASE WHEN error IS NULL THEN f END AS v_first, CASE WHEN error IS NULL THEN t END AS v_last, error AS error_type FROM e"
    )
)
def reference_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of three parts, `GEN 3:4; 5:6-8, 9`: the book is carried on to the second part, and its chapter to the third.

    A bare number beyond the chapter's verses is no reference at all.
    """
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    n = lambda x, m: (x % m + 1).cast("string")
    codes = F.broadcast(load().frame(spark).select(F.col("ord").alias("b"), "usfm_id"))  # 113 books
    orders = table(spark, sf_dir, "orders").withColumn("b", (c % 66).cast("int")).join(codes, "b")
    text = F.concat("usfm_id", F.lit(" "), n(o, 30), F.lit(":"), n(c, 30), F.lit("; "), n(c, 20), F.lit(" : "), n(o, 25), F.lit("-"), (o % 25 + 3).cast("string"), F.lit(", "), n(o, 9))
    return orders.select("o_orderkey", F.explode(parse_column(text)).alias("r")).select("o_orderkey", "r.part_no", "r.book_ord", "r.chapter", "r.v_first", "r.v_last", "r.error_type")


_CODED = "SELECT o_orderkey, CAST(o_custkey % 66 AS INTEGER) AS b, counts, CAST(o_orderkey % len(counts) + 1 AS INTEGER) AS c FROM orders JOIN dim ON ord = o_custkey % 66"


@query(lambda: f"WITH {dim_sql(load())}, o AS ({_CODED}) SELECT o_orderkey, b AS book_ord, c AS chapter, CAST(o_orderkey // 3 % counts[c] + 1 AS INTEGER) AS v_first, CAST(greatest(o_orderkey // 3 % counts[c], o_orderkey // 7 % counts[c]) + 1 AS INTEGER) AS v_last, false AS failed FROM o")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of verses as codes, and what the codes decode to; a code that cannot be made or read is a failure."""
    known = load()
    counts = [list(b.verse_counts) for b in known.books]

    @F.pandas_udf("struct<book_ord: int, chapter: int, v_first: int, v_last: int, failed: boolean>")
    def through(order: pd.Series, customer: pd.Series) -> pd.DataFrame:
        def one(o: int, c: int) -> tuple:
            book = int(c) % 66
            chapter = int(o) % len(counts[book]) + 1
            n = counts[book][chapter - 1]
            first = int(o) // 3 % n + 1
            r = Reference(book, chapter, first, max(first, int(o) // 7 % n + 1))
            try:
                (back,) = codec.decode(codec.encode([r], known), known)
            except (codec.CodecError, ValueError):
                return None, None, None, None, True
            return back.book, back.chapter, back.first, back.last, False

        return pd.DataFrame([one(o, c) for o, c in zip(order, customer, strict=True)], columns=["book_ord", "chapter", "v_first", "v_last", "failed"])

    return table(spark, sf_dir, "orders").select("o_orderkey", through("o_orderkey", "o_custkey").alias("r")).select("o_orderkey", "r.*")


@query("WITH m AS (SELECT max(o_orderkey) AS top FROM orders) SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'id' WHEN CAST(o_custkey AS BIGINT) * 100 < top + 1 THEN 'encoded' ELSE 'new' END AS kind, CASE WHEN o_custkey % 10 = 0 THEN o_orderkey WHEN CAST(o_custkey AS BIGINT) * 100 < top + 1 THEN CAST(o_custkey AS BIGINT) * 100 ELSE top + 1 END AS value FROM orders, m")
def shorturl_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a link store gives out, by its own rule: the id of a stored list, the code of a short one, or the next id."""
    orders = table(spark, sf_dir, "orders")
    top = int(orders.agg(F.max("o_orderkey")).first()[0] or 0)

    @F.pandas_udf("struct<kind: string, value: long>")
    def rule(key: pd.Series, customer: pd.Series) -> pd.DataFrame:
        given = [links.choose(int(k) if c % 10 == 0 else None, top, int(c) * 100, False, lambda _: False) for k, c in zip(key, customer, strict=True)]
        return pd.DataFrame(given, columns=["kind", "value"])

    return orders.select("o_orderkey", rule("o_orderkey", "o_custkey").alias("r")).select("o_orderkey", "r.kind", "r.value")


LISTS = (("RUT 1:2-4, JON 3", "Ruth 1:2-4;Jonah 3"), ("PSA 119:5-100, ISA 40:3-9, MIC 6", "Psalms 119:5-100;Isaiah 40:3-9;Micah 6"), ("RUT 1:2-4,JON 3", "Ruth 1:2-4;Jonah 3"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{want}')" for i, (_, want) in enumerate(LISTS)) + ") t(list_no, shown)")
def links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of references stored as links, and what the links resolve to."""
    store = links.LinkStore(spark, f"{scratch(spark)}/links")
    made = [store.create(text) for text, _ in LISTS]
    rows = [(i, ";".join(store.resolve(m["type"], m["value"]))) for i, m in enumerate(made)]
    return spark.createDataFrame(rows, "list_no int, shown string")


# Markers and numbers --------------------------------------------------------------------------------------------------

#: Marker names with the largest number they take, as the tables ask for them; `zz` is none.
ASKED = (("q", 4), ("mt", 4), ("p", 0), ("zz", 0))


@query(
    "WITH m(k, base, top) AS (VALUES " + ", ".join(f"({i}, '{b}', {t})" for i, (b, t) in enumerate(ASKED)) + "), o AS (SELECT o_orderkey, base, top, CAST(o_custkey % 7 AS INTEGER) AS n FROM orders JOIN m ON k = o_orderkey % 4) "
    "SELECT o_orderkey, CASE WHEN base <> 'zz' AND n <= top THEN base END AS base, CASE WHEN base <> 'zz' AND top > 0 AND n <= top THEN greatest(n, 1) END AS number, CASE WHEN base = 'zz' THEN 'unknown' WHEN n > top THEN 'range' END AS error, base = 'mt' AS is_title FROM o"
)
def marker_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers with numbers from none to six, some beyond what the marker takes, some unknown."""

    names = F.array(*[F.lit(b) for b, _ in ASKED])
    n = (F.col("o_custkey") % 7).cast("string")
    marker = F.concat(F.get(names, (F.col("o_orderkey") % 4).cast("int")), F.when(n == "0", "").otherwise(n))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", marker.alias("marker")).withColumn("m", parse_marker(F.col("marker")))
    return rows.select("o_orderkey", "m.base", F.col("m.low").alias("number"), "m.error", markers.is_title(F.col("marker")).alias("is_title"))


@query(
    "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'GEN' ELSE '5EZ' END AS book, CAST(o_custkey % 50 + 1 AS INTEGER) AS chapter, CAST(o_orderkey % 30 + 1 AS INTEGER) AS a, CAST(o_orderkey % 30 + 1 + o_custkey % 3 AS INTEGER) AS b, o_orderkey % 5 AS k FROM orders) "
    "SELECT o_orderkey, CASE WHEN k <> 4 THEN book END AS book, CASE WHEN k <> 4 THEN chapter END AS chapter, CASE WHEN k NOT IN (0, 4) THEN a END AS v_first, CASE WHEN k NOT IN (0, 4) THEN b END AS v_last, CASE WHEN k <> 4 THEN book || ' ' || chapter || CASE WHEN k = 0 THEN '' WHEN a = b THEN ':' || a ELSE ':' || a || '-' || b END END AS shown, k <> 4 AS machine FROM o"
)
def sid_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of chapters and verses read and written again; every fifth is prose, which is none."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a, b = (k % 30 + 1).cast("string"), (k % 30 + 1 + c % 3).cast("string")
    book = F.when(k % 2 == 0, "GEN").otherwise("5EZ")
    sid = F.when(k % 5 == 4, F.lit("In the third chapter")).otherwise(F.concat(book, F.lit(" "), (c % 50 + 1).cast("string"), F.when(k % 5 == 0, "").when(a == b, F.concat(F.lit(":"), a)).otherwise(F.concat(F.lit(":"), a, F.lit("-"), b))))

    rows = table(spark, sf_dir, "orders").select("o_orderkey", sid.alias("sid")).withColumn("r", markers.sid_column(F.col("sid")))
    return rows.select("o_orderkey", "r.*", F.col("sid").rlike(markers.MACHINE).alias("machine"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN a <= b THEN CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END END AS verses, CASE WHEN a <= b THEN a <= 7 AND 7 <= b END AS holds_7 FROM (SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 20 + 1 AS INTEGER) AS a, CAST(l_partkey % 20 + 1 AS INTEGER) AS b FROM lineitem)")
def verse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges as text, with letters around the numbers, read and shown again; falling ones are refused."""

    text = F.concat((F.col("l_suppkey") % 20 + 1).cast("string"), F.lit("a-b"), (F.col("l_partkey") % 20 + 1).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", verse_range(text).alias("r"))
    a, b = F.col("r.first"), F.col("r.last")
    return rows.select("l_orderkey", "l_linenumber", F.when(a.isNotNull(), markers.range_text(a, b)).alias("verses"), ((a <= 7) & (b >= 7)).alias("holds_7"))


# The engine -----------------------------------------------------------------------------------------------------------


@query(f"{CORPUS_SQL}, x AS (SELECT book_ord, chapter, verse, count(*) AS n FROM w WHERE corpus_id = 'en-0' AND lemma IN ('the', 'and') GROUP BY ALL HAVING count(*) = 2) SELECT CAST(row_number() OVER (ORDER BY book_ord, chapter, verse) AS INTEGER) AS place, book_ord, chapter, verse, CAST(n AS INTEGER) AS highlights, (SELECT count(*) FROM x) AS total FROM x ORDER BY book_ord, chapter, verse LIMIT 20")
def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a term search through the engine: references in canonical order, each with its highlights, and the total."""
    from ..engine import Engine

    n = corpus_nodes(spark, sf_dir).where("corpus_id = 'en-0'")
    path = scratch(spark)
    write_snapshot(path, n, index.postings(n), {})
    found = Engine.from_snapshot(spark, path).search("en-0", "the and", count=20)
    ords = {b.usfm_id: b.ord for b in load().books}
    rows = [(i + 1, ords[r["reference"]["book"]], r["reference"]["chapter"], r["reference"]["verses"][0], len(r["highlights"]), found["total_results"]) for i, r in enumerate(found["references"])]
    return spark.createDataFrame(rows, "place int, book_ord int, chapter int, verse int, highlights int, total long")
