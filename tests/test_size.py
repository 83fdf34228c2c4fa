"""What queries shuffle and read again, where that once kept large tables from being done."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import nodes as node_ops


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def usj(code: str, *chapters: int) -> str:
    rest = "".join(f',{{"type":"chapter","marker":"c","number":"{c}"}},{{"type":"para","marker":"p","content":[{{"type":"verse","marker":"v","number":"{c + 1}"}},"text {c}"]}}' for c in chapters)
    return f'{{"type":"USJ","version":"3.1","content":[{{"type":"book","marker":"id","code":"{code}","content":["about"]}}{rest}]}}'


def test_nodes_are_read_and_shuffled_once(spark, tmp_path):
    """The first path of a book counts, whatever the order of files; a file that is no book, or cannot be read, has no nodes."""
    files = [("a", "2.usj", usj("GEN", 7)), ("a", "1.usj", usj("GEN", 1, 2)), ("a", "3.usj", usj("EXO", 3)), ("b", "9.usj", usj("GEN", 4)), ("b", "8.usj", usj("???", 5)), ("b", "0.usj", "{")]
    given = spark.createDataFrame([(c, p, "usj", t) for c, p, t in files], "corpus_id string, path string, kind string, text string")
    node_ops.parse_files(given).write.parquet(str(tmp_path / "parsed"))
    parsed = spark.read.parquet(str(tmp_path / "parsed"))
    n = node_ops.nodes(parsed)
    assert plan(n).count("Exchange hashpartitioning") == 1 and plan(n).count("FileScan") == 1
    texts = n.where("type = 'text' and v_first is not null").select("corpus_id", "book_ord", "text", "chapter", "v_first", "v_last")
    exo = n.where("code = 'EXO'").first()["book_ord"]
    gen = n.where("code = 'GEN'").first()["book_ord"]
    assert sorted(map(tuple, texts.collect())) == sorted([("a", gen, "text 1", 1, 2, 2), ("a", gen, "text 2", 2, 3, 3), ("a", exo, "text 3", 3, 4, 4), ("b", gen, "text 4", 4, 5, 5)])
    chosen = node_ops.books_of(parsed).where("not ignored").count()
    assert n.where("type = 'book'").count() == chosen == 3
    assert n.groupBy("corpus_id", "book_ord").agg((F.max("seq") + 1 == F.count(F.lit(1))).alias("whole")).where("not whole").count() == 0


def test_texts_without_the_words_are_told_without_cutting_them(spark):
    """Nothing that holds a word is passed over, whatever its case and marks."""
    from lectern.functions.tokens import lemmas, may_hold

    texts = ["The end", "nothing of it", "THÉ", "für", "fur", "FUR.", "other", "K", "k", "t h e", "", "ünd", "there"]
    asked = ["the", "fur", "k"]
    got = {r["text"]: r["held"] for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", may_hold(F.col("text"), asked).alias("held")).collect()}
    assert all(got[t] for t in texts if set(lemmas(t)) & set(asked))
    assert not any(got[t] for t in ("nothing of it", "t h e", ""))


def test_searches_cut_texts_into_words_once(spark):
    """What hits and rules read twice is stored; rules that are few reach the places without a shuffle of the places by key."""
    from lectern.plans.queries import QUERIES

    for name in ("search_page", "search_total", "interval_rules_of_orders", "footnote_single_word", "footnote_phrase_rules"):
        assert "documents.parquet" not in plan(QUERIES[name](spark, "/root/testdata/sf0.001")), name
    assert "Exchange" not in plan(QUERIES["highlight_pieces"](spark, "/root/testdata/sf0.001")).replace("Exchange RoundRobin", "")


def test_places_are_asked_for_at_the_lengths_of_the_rules_only(spark):
    """Rules of two books in a row have no longer pieces than that, however far numbers reach."""
    from lectern.operators import intervals

    ref = "struct<book_ord: long, chapter: int, v_first: int, v_last: int>"
    rules = spark.createDataFrame([("a", (10**6, 0, 0, 0), (10**6 + 2, 0, 0, 0), 0, "x")], f"lemma string, low {ref}, high {ref}, priority int, note string")
    rows = spark.createDataFrame([("a", 10**6 + k, 1, 1, 1) for k in range(4)], "lemma string, book_ord long, chapter int, v_first int, v_last int")
    held = intervals.holding(rows, rules, ["lemma"])
    assert sorted(r["book_ord"] for r in held.collect()) == [10**6, 10**6 + 1]
    asked = intervals.lookup(rules, ["lemma"], intervals.tops_of(rules)).select("axis", "level").distinct().count()
    assert asked < 10 and held._jdf.queryExecution().optimizedPlan().toString().count("shiftright") <= asked


def test_a_long_tree_is_walked_in_proportion(spark):
    """The depths of a tree's nodes are worked out once, not for each node again; with 12,000 nodes that did not end in 75 s."""
    import time

    from lectern.sources.usj_variant import parse_trees

    tree = usj("GEN", *(k % 200 + 1 for k in range(3000)))
    files = spark.createDataFrame([("a", "1.usj", tree)], "corpus_id string, path string, text string")
    began = time.time()
    rows = parse_trees(files).agg(F.count(F.lit(1)), F.max("seq"), F.max("last")).first()
    assert tuple(rows) == (12003, 12002, 12002)
    assert time.time() - began < 30


def test_placed_nodes_are_those_of_the_shuffle(spark, tmp_path):
    """Chapters and verses that hold are told where a file is read, so that its nodes are not shuffled; a row a file tells which files count."""
    two = '{"type":"USJ","version":"3.1","content":[{"type":"para","marker":"p","content":[{"type":"verse","marker":"v","number":"9"},"before"]},{"type":"book","marker":"id","code":"LEV","content":["about"]},{"type":"book","marker":"id","code":"RUT"}]}'
    files = [("a", "2.usj", "usj", usj("GEN", 7)), ("a", "1.usj", "usj", usj("GEN", 1, 2)), ("a", "3.usj", "usj", two), ("b", "8.usj", "usj", usj("???", 5)), ("b", "0.usj", "usj", "{")]
    files += [("b", "9.usfm", "usfm", "\\id EXO Two\n\\h Name\n\\p\n\\v 3 early\n\\c 1\n\\s1 Head\n\\p\n\\v 1-2 one\\f + \\ft two\\f*\n\\q1\n\\v 3 three\n\\nonsense x\n\\c 2\n\\p\n\\v 1 four"), (None, "7.usj", "usj", usj("RUT", 1))]
    given = spark.createDataFrame(files, "corpus_id string, path string, kind string, text string")
    node_ops.parse_placed(given).write.parquet(str(tmp_path / "placed"))
    placed = node_ops.placed_nodes(spark.read.parquet(str(tmp_path / "placed")))
    assert "Exchange hashpartitioning" not in plan(placed)
    n = node_ops.nodes(node_ops.parse_files(given))
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(placed) == rows(n) and len(rows(n)) > 20 and set(placed.columns) == set(n.columns)
    by = lambda df: sorted(map(str, df.select("corpus_id", "path_name", "code_found", "book_ord", "ignored").collect()))
    assert by(node_ops.books_of(node_ops.parse_books(given))) == by(node_ops.books_of(node_ops.parse_files(given)))
    assert node_ops.parse_books(given).count() == len(files)


def test_names_and_descriptions_meet_few_texts(spark, tmp_path):
    """Texts are joined by their places and those of verses are passed over; a book that does not describe itself stays."""
    text = "\\id GEN About it\n\\h Name\n\\toc1 Long\n\\c 1\n\\p\n\\v 1 one\n\\h Late\n\\v 2 two"
    bare = '{"type":"USJ","version":"3.1","content":[{"type":"book","marker":"id","code":"EXO"},{"type":"chapter","marker":"c","number":"1"},{"type":"para","marker":"p","content":["text"]}]}'
    files = spark.createDataFrame([("a", "1.usfm", "usfm", text), ("a", "2.usj", "usj", bare)], "corpus_id string, path string, kind string, text string")
    node_ops.nodes(node_ops.parse_files(files)).write.parquet(str(tmp_path / "n"))
    n = spark.read.parquet(str(tmp_path / "n"))
    info = node_ops.book_info(n)
    assert sorted(map(tuple, info.select("code", "description").collect())) == [("EXO", None), ("GEN", "About it")]
    named = node_ops.translated_book_info(n)
    assert [(r["running_header"], r["long"]) for r in named.collect()] == [("Name", "Long")]
    assert "(in_para" in plan(info) and "isnull(chapter" in plan(named)


def test_a_vocabulary_is_counted_without_sorting_postings(spark):
    """Places of all sizes compare as they are, and words numbered through a document are those of its sentences."""
    import re

    from lectern.operators import index
    from lectern.plans.adapter import document_words, postings

    top, big = 2**63 - 1, 2**31 - 1
    rows = [("c", "a", "A1", top, 0, 0), ("c", "a", "A2", -top - 1, big, big), ("c", "a", "A3", -top - 1, big, big - 1), ("c", "a", "a", -top - 1, 0, 0), ("c", "b", "B1", top, big, big), ("c", "b", "B2", top, big - 1, big), ("d", "b", "b", 0, 0, 0)]
    p = spark.createDataFrame(rows, "corpus_id string, lemma string, surface string, book_ord long, segment int, pos int")
    v = index.vocabulary(p)
    assert sorted(map(tuple, v.select("corpus_id", "lemma", "total", "name").collect())) == [("c", "a", 4, "A3"), ("c", "b", 2, "B2"), ("d", "b", 1, "b")]
    assert re.search(r"HashAggregate\(keys=\[corpus_id#\d+, lemma#\d+, surface#\d+\], functions=\[partial_count", plan(v))
    texts = ["One two. Three?!four\n\n...five 5,6\r\nÄpfel été ́x. .y", "", None, "漢字 kana. ไทย\n字。a b!c"]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    ordered = lambda df, *by: [(r["book_ord"], r["surface"], r["lemma"]) for r in df.orderBy("book_ord", *by).collect()]
    assert ordered(document_words(docs), "pos") == ordered(postings(docs), "segment", "pos") != []


def test_files_reach_workers_in_small_batches(spark):
    """A batch of files is bounded by bytes, not by 10,000 rows or 64 MB: a task holds it several times."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    files = spark.range(200, numPartitions=1).select(F.lit("a").alias("corpus_id"), F.col("id").cast("string").alias("path"), F.lit("usj").alias("kind"), F.repeat(F.lit("x"), 100_000).alias("text"))
    assert node_ops.parse_books(files).count() == 200

    def sizes(batches):
        for b in batches:
            yield type(b).from_pydict({"n": [b.nbytes]})

    got = [r["n"] for r in files.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 20_000_000 and max(got) < 6_000_000


def test_only_marks_and_their_texts_meet_the_windows_of_segments(spark, tmp_path):
    """Notes, paragraphs and the rest are left out where nodes are read, and marks are counted in one order."""
    from lectern.operators import index
    from lectern.plans.queries import QUERIES

    text = "\\id GEN About it\n\\c 1\n\\p\n\\v 1 one\\f + \\ft note\\f* more\n\\v 2 two\n\\s1 Head\n\\p\n\\v 2 again\n\\q1 on"
    files = spark.createDataFrame([("a", "1.usfm", "usfm", text)], "corpus_id string, path string, kind string, text string")
    node_ops.nodes(node_ops.parse_files(files)).write.parquet(str(tmp_path / "n"))
    segs = index.segments(spark.read.parquet(str(tmp_path / "n")))
    assert sorted((r["v_first"], r["text"].strip()) for r in segs.collect()) == [(1, "one more"), (2, "again"), (2, "on"), (2, "two")]
    scans = [x for x in plan(segs).splitlines() if "FileScan" in x]
    assert scans and all("(type#" in x.split("DataFilters:")[1] for x in scans)
    p = plan(QUERIES["segment_text"](spark, "/root/testdata/sf0.001"))
    assert "root_no" not in "".join(x for x in p.splitlines() if "Sort [" in x)


def test_many_rules_and_rows_are_not_broadcast(spark):
    """Stored rows are small on disk: some hundred thousands of them were sent to all tasks, and the driver had no memory for them."""
    from lectern.operators import intervals

    k = F.col("id")
    end = lambda c, v: F.struct(c.alias("book_ord"), v.cast("int").alias("chapter"), v.cast("int").alias("v_first"), v.cast("int").alias("v_last"))
    rules = lambda n: spark.range(n).select(F.lit("a").alias("lemma"), end(k, k % 3).alias("low"), end(k + 1, k % 5).alias("high"), k.alias("priority"), k.cast("string").alias("note"))
    rows = lambda n: spark.range(n).select(F.lit("a").alias("lemma"), (k % 1000).alias("book_ord"), F.lit(1).alias("chapter"), F.lit(1).alias("v_first"), F.lit(1).alias("v_last"))
    many = intervals.holding(rows(60_000), rules(20_000), ["lemma"])
    joins = [x.strip(" +-:") for x in plan(many).splitlines() if "Join" in x and "LeftSemi" not in x]
    assert len(joins) == 2 and all(x.startswith("SortMergeJoin") for x in joins), joins
    few = intervals.holding(rows(1000), rules(100), ["lemma"])
    assert "Inner, Build" in plan(few)
    held = lambda df: {(r["book_ord"], r["note"]) for r in df.where("book_ord < 90").select("book_ord", "note").collect()}
    assert held(many) == held(few) and len(held(few)) > 80


def test_a_snapshot_shuffles_segments_and_not_words(spark, tmp_path):
    """Postings that are dealt to buckets are written where they are cut, with those of attributes, and scratch folders do not outlive their use."""
    import os

    from lectern.operators import index
    from lectern.session import passing, stored
    from lectern.sources.snapshot import deal, read_snapshot, write_snapshot

    text = '\\id {} About it\n\\c 1\n\\p\n\\v 1 one\\f + \\ft note\\f* more\n\\v 2 \\w two|lemma="deux trois"\\w*\n\\p on'
    files = [("a", "1.usfm", "usfm", text.format("GEN")), ("a", "2.usfm", "usfm", text.format("EXO")), ("b", "1.usfm", "usfm", text.format("GEN"))]
    given = spark.createDataFrame(files, "corpus_id string, path string, kind string, text string")
    with passing(spark):
        n = stored(node_ops.nodes(node_ops.parse_files(given)))
        folder = n.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        p = index.postings(n, deal=deal())
        words = "".join(x for x in plan(p).splitlines() if x.startswith("   :"))  # the first branch of the union
        assert words.count("Exchange hashpartitioning") == 1 and "hashpartitioning(bucket" in words
        counts = write_snapshot(str(tmp_path / "s"), n, p, {})
        _, got, _ = read_snapshot(spark, str(tmp_path / "s"))
        rows = lambda df: sorted(str(r) for r in df.select(sorted(df.columns)).collect())
        assert rows(got) == rows(index.postings(n)) and counts["words"] == len(rows(got)) > 9
        assert got.where("from_attr").count() == 6
        assert os.path.exists(folder)
    assert not os.path.exists(folder)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_words_without_places_are_those_of_the_postings(spark):
    """What adds up no offsets finds the same words, in every script, and numbers them alike."""
    from lectern.operators import index

    texts = ["One two. \u0301Three?!four", "...five 5,6 A\u0308pfel \u00e9te\u0301 \u0301x. .y", "\u6f22\u5b57 kana. \u0e44\u0e17\u0e22\u0e48 \u5b57\u0301a b!c", "\u30ab\u3099x\u0e48", "", "..."]
    body = ",".join('{"type":"verse","marker":"v","number":"%d"},"%s"' % (i + 1, t) for i, t in enumerate(texts))  # noqa: UP031
    tree = '{"type":"USJ","version":"3.1","content":[{"type":"book","marker":"id","code":"GEN"},{"type":"chapter","marker":"c","number":"1"},{"type":"para","marker":"p","content":[' + body + "]}]}"
    files = spark.createDataFrame([("a", "1.usj", "usj", tree)], "corpus_id string, path string, kind string, text string")
    n = node_ops.nodes(node_ops.parse_files(files)).cache()
    columns = ["corpus_id", "lemma", *index.REF, "segment", "pos", "surface"]
    rows = lambda df: sorted(map(tuple, df.select(columns).collect()))
    assert rows(index.words(n)) == rows(index.postings(n)) and len(rows(index.words(n))) > 20
    assert "lambdafunction" not in plan(index.words(n)).split("Union")[1].split("SortMergeJoin")[0].split("Generate posexplode")[1].split("\n")[0]
