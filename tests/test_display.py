"""What clients do with results, and the stores of links."""

from __future__ import annotations

import threading

import pytest

from lectern.functions.references import Reference
from lectern.functions.tokens import lemma, lemma_column, lemmas, surface_array
from lectern.operators import display
from lectern.operators.links import JdbcLinks, LinkError, LinkStore, ParquetLinks, choose, offensive


def test_marked_texts():
    content = [{"type": "para", "marker": "p", "content": ["a bright ", {"type": "char", "marker": "nd", "content": ["morn"]}, "ing came"]}]
    spans = [{"start": {"path": [0, 0], "ch": 2}, "end": {"path": [0, 0], "ch": 8}}, {"start": {"path": [0, 1, 0], "ch": 0}, "end": {"path": [0, 2], "ch": 3}}]
    assert display.marked(content, spans) == [
        ((0, 0), [("a ", False), ("bright", True), (" ", False)]),
        ((0, 1, 0), [("morn", True)]),
        ((0, 2), [("ing", True), (" came", False)]),
    ]
    assert display.marked(["x"], []) == [((0,), [("x", False)])] and display.marked([], spans) == []


def test_labels():
    mark, verse = {"type": "chapter", "marker": "c", "number": "3", "pubnumber": "C"}, {"type": "para", "marker": "p", "content": ["text"]}
    own, common = ({"type": "para", "marker": "cl", "content": [t]} for t in ("Psalm the third", "Psalm"))
    assert display.with_label([verse], "Songs") == [verse]
    assert display.with_label([mark, verse], "Songs")[0]["content"] == ["Songs C"]
    assert display.with_label([mark, own, verse], "Songs") == [own, mark, verse]
    assert display.with_label([common, mark, own, verse], "Songs") == [own, mark, verse]
    assert display.with_label([common, mark, verse], "Songs")[0]["content"] == ["Psalm", " C"] and common["content"] == ["Psalm"]
    assert display.label_of([mark, verse], "Songs") == "Songs C" and display.label_of([common, mark], "Songs") == "Psalm C"
    assert display.covers_chapter(7, 1, 1, 22) and not display.covers_chapter(7, 1, 1, 21)


def test_one_lemma_in_python_and_the_jvm(spark):
    texts = ["Für ÉTÉ e\u0301te\u0301 où más", "Œuvre ﬁn Æsop ĳs", "日本語 テキスト ที่นี่ 한국어 हिन्दी", "naïve12 x_y ½ ＡＢＣ", "Đông ılık İz ΣΟΦΟΣ", "שָׁלוֹם كِتَاب", "", "…", "a\u0327b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").selectExpr("i", "t").withColumn("s", surface_array_of("t")).collect()
    for r in rows:
        assert [lemma(w) for w in r["s"]] == lemmas(r["t"]), r["t"]
    words = spark.createDataFrame([(w,) for r in rows for w in r["s"]], "w string")
    assert all(r["l"] == lemma(r["w"]) for r in words.withColumn("l", lemma_column(words["w"])).collect())
    assert lemma("Für") == "fur" and lemma("e\u0301te\u0301") == lemma("été") == "ete"


def surface_array_of(name: str):
    from pyspark.sql import functions as F

    return surface_array(F.col(name))


def test_choices_and_words_that_are_passed_over():
    never = lambda _: False
    assert choose(5, 9, 3, False, never) == ("id", 5) and choose(None, 9, 3, False, never) == ("encoded", 3)
    assert choose(None, 9, 30, False, never) == ("new", 10) and choose(None, 9, 30, True, never) == ("encoded", 30)
    with pytest.raises(LinkError):
        choose(None, 9, None, True, never)
    assert offensive("xsh1tx") and offensive("FuCk2") and not offensive("a") and not offensive("river9")


def test_two_creators_never_share_an_id(spark, tmp_path):
    made, lists = [], [f"PSA 119:{i}-90, ISA {i}:1-3, JER {i}:2-4" for i in range(2, 6)]
    folder = str(tmp_path / "links")

    def create(text: str) -> None:
        made.append(LinkStore(spark, folder).create(text)["value"])

    threads = [threading.Thread(target=create, args=(t,)) for t in lists]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(set(made)) == 4
    store = LinkStore(spark, folder)
    assert len({tuple(store.resolve("id", v)) for v in made}) == 4


def test_links_in_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    con = spark._jvm.java.sql.DriverManager.getConnection(url)
    con.createStatement().execute("CREATE TABLE short_links (id BIGINT PRIMARY KEY, refs_key VARCHAR(4000))")
    con.close()
    links = JdbcLinks(spark, url)
    store = LinkStore(spark, links)
    first = store.create("PSA 119:5-100, ISA 40:3-9, MIC 6")
    assert first == {"type": "id", "value": "2"} or first["type"] == "id"
    assert store.create("PSA 119:5-100,ISA 40:3-9;MIC 6") == first
    assert store.resolve("id", first["value"]) == ["Psalms 119:5-100", "Isaiah 40:3-9", "Micah 6"]
    assert not links.add(1, "0.1.1.1", [Reference(0, 1, 1, 1)]) and links.table().count() == 1


def test_a_list_that_cannot_be_coded_is_refused(spark, tmp_path):
    with pytest.raises(LinkError) as e:
        LinkStore(spark, ParquetLinks(spark, str(tmp_path / "x"))).create("RUT 1:1-5, RUT 1:3-4")
    assert e.value.status == 400
