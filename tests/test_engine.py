from __future__ import annotations

import zipfile

import corpus
import pytest

from lectern.config import EngineConfig
from lectern.engine import BadRequest, Engine, NotFound
from lectern.operators import nodes as nd
from lectern.operators.links import LinkError, LinkStore
from lectern.operators.search import SearchError
from lectern.streaming.incremental import Maintainer


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    e = Engine.from_folder(spark, corpus.write(root), EngineConfig(links_path=str(root / "links")))
    e.nodes, e.postings = e.nodes.cache(), e.postings.cache()
    return e


def refs(answer):
    return [(r["reference"]["book"], r["reference"]["chapter"], *r["reference"]["verses"]) for r in answer["references"]]


def text_of(content):
    return "".join(content) if isinstance(content, str) else "".join(text_of(c) for c in (content if isinstance(content, list) else content.get("content", [])))


def test_browse(engine):
    assert engine.corpora() == {"default_corpus": "small", "corpora": {"small": {"display_name": "Small", "text_direction": "ltr", "simple_book_names": {"GEN": "Beginnings", "EXO": "Roads"}}}}
    books = engine.books("small")
    assert [c["number"] for c in books["books"]["EXO"]["chapters"]] == [1, 3] and books["book_order"] == ["GEN", "EXO"]
    assert books["books"]["GEN"]["translated_book_info"] == {"running_header": "Beginnings", "long": "The Book of Beginnings", "short": "Beginnings", "abbreviation": "Beg"}
    assert engine.book("small", "1Bk")["content"][0]["code"] == "GEN"
    with pytest.raises(BadRequest):
        engine.book("small", "nothing")
    with pytest.raises(NotFound):
        engine.info("absent")


def test_term_search(engine):
    a = engine.search("small", "river")
    assert (a["response_type"], a["total_results"]) == ("search_results", 3)
    assert refs(a) == [("GEN", 1, 1, 1), ("GEN", 1, 2, 2), ("EXO", 1, 1, 1)]
    for item in a["references"]:
        (light,) = item["highlights"]
        node = item["content"]
        for i in light["start"]["path"]:
            node = node[i] if isinstance(node, list) else node["content"][i]
        assert node[light["start"]["ch"] : light["end"]["ch"]].lower() == "river"


def test_count_rules(engine):
    # occurrences: a verse with a word twice answers two words, and not one
    assert refs(engine.search("small", "second stone")) == [("GEN", 1, 5, 5)]
    assert refs(engine.search("small", "second stone", mode="all_terms")) == [("GEN", 2, 1, 1)]
    assert ("GEN", 1, 5, 5) not in refs(engine.search("small", "stone"))
    # a word that repeats in the query counts on both sides
    assert len(refs(engine.search("small", "river river"))) == 3
    assert refs(engine.search("small", "the nosuchword")) == []
    assert refs(engine.search("small", "dawn")) == [("GEN", 1, 5, 5)]


def test_pages(engine):
    a = engine.search("small", "river", 1, 1)
    assert a["total_results"] == 3 and refs(a) == [("GEN", 1, 2, 2)]
    with pytest.raises(SearchError):
        engine.search("small", "river", 0, 251)


def test_index(engine):
    words = {r["name"]: r["total"] for r in engine.index("small").collect()}
    assert words["River"] == 3 and words["stone"] == 6 and "the" not in words
    assert list(words) == sorted(words, key=str.lower)


def test_passages(engine):
    a = engine.search("small", "GEN 1:3; GEN 1:1-2; EXO 1:2; GEN 1:99", generate_footnotes=False)
    assert a["response_type"] == "scripture_passages" and a["total_results"] == 4
    three, whole, road, wrong = a["references"]
    assert [n.get("marker") for n in three["content"]] == ["s1", "b", "s2", "p", "q1"]
    assert [n.get("marker") for n in whole["content"]] == ["cl", "c", "s1", "p"]
    assert text_of(road["content"]).strip() == "Two roads, one stone."
    assert wrong["error_type"] == "out_of_bounds_verse" and wrong["source_reference"] == "GEN 1:99"


def test_neighbours(engine):
    one, two, three = engine.search("small", "GEN 2:1; EXO 2; EXO 3:1")["references"]
    assert (one["previous_chapter"], one["next_chapter"]) == ({"book": "GEN", "chapter": 1}, {"book": "EXO", "chapter": 1})
    assert (two["content"], two["previous_chapter"], two["next_chapter"]) == (None, {"book": "EXO", "chapter": 1}, {"book": "EXO", "chapter": 3})
    assert "next_chapter" not in three


def test_footnotes(engine):
    (a,) = engine.search("small", "GEN 1:1-2")["references"]
    notes = [n for p in a["content"] for n in p.get("content", []) if isinstance(n, dict) and n["type"] == "note"]
    assert [text_of(n) for n in notes] == ["1:1 A river.", "a note about water"]  # the second river has none
    (b,) = engine.search("small", "GEN 2:1")["references"]
    content = b["content"][-1]["content"]
    assert content[1] == "A second day, a second stone" and text_of(content[2]) == "2:1 Stones." and content[3] == ".\n"
    (c,) = engine.search("small", "EXO 3:1")["references"]
    assert "note" not in str(c["content"])


def test_snapshot(engine, spark, tmp_path):
    engine.bake(str(tmp_path / "snap"))
    again = Engine.from_snapshot(spark, str(tmp_path / "snap"))
    assert again.search("small", "river") == engine.search("small", "river")
    assert again.search("small", "GEN 1") == engine.search("small", "GEN 1")


def test_links(engine, spark, tmp_path):
    store = LinkStore(spark, str(tmp_path / "links"))
    first = store.create("GEN 1:1; EXO 3")
    assert first == store.create("GEN 1:1; EXO 3") == {"type": "id", "value": "1"}
    assert store.resolve("id", "1") == ["Genesis 1:1", "Exodus 3"]
    for text in ("GEN 1:2", "GEN 1:3", "GEN 1:4", "GEN 1:5", "GEN 1:6", "GEN 1:7"):
        store.create(text)
    assert store.create("GEN 1:1") == {"type": "encoded", "value": "6"} and store.resolve("encoded", "6") == ["Genesis 1:1"]
    for call, status in ((lambda: store.create("nonsense"), 400), (lambda: store.resolve("id", "zz"), 404), (lambda: store.resolve("id", "-"), 400)):
        with pytest.raises(LinkError) as e:
            call()
        assert e.value.status == status
    fixed = LinkStore(spark, str(tmp_path / "links"), read_only=True)
    assert fixed.create("LUK 3:4")["type"] == "encoded"
    with pytest.raises(LinkError) as e:
        fixed.create(";".join(f"PSA {i}:2" for i in range(1, 60, 3)))
    assert e.value.status == 409
    rude = LinkStore(spark, str(tmp_path / "other"), forbidden=lambda c: c == "1")
    assert rude.create("PSA 3:3")["value"] != "1"


def test_partial_updates_equal_a_rebuild(spark, tmp_path):
    root = corpus.write(tmp_path)
    m = Maintainer(spark, root, str(tmp_path / "store"))
    m.rebuild()
    folder = tmp_path / "corpora" / "small"

    def rows(m):
        n, p = m.tables()
        pick = p.select("corpus_id", "book_ord", "lemma", "chapter", "v_first", "segment", "pos")
        return sorted(map(str, pick.collect())), n.count()

    def fresh():
        other = Maintainer(spark, root, str(tmp_path / f"fresh{len(list(tmp_path.iterdir()))}"))
        other.rebuild()
        return rows(other)

    assert m.update() == set()
    (folder / "02-EXO.usfm").write_text(corpus.EXO.replace("stone", "pebble").replace("\\c 3", "\\c 4"))
    assert m.update() == {("small", 1)} and rows(m) == fresh()
    (folder / "03-LEV.usfm").write_text("\\id LEV\n\\c 1\n\\p\n\\v 1 new words")
    (folder / "01-GEN.usfm").rename(folder / "07-GEN.usfm")
    assert m.update() == {("small", 0), ("small", 2)} and rows(m) == fresh()
    (folder / "02-EXO.usfm").unlink()
    assert m.update() == {("small", 1)} and rows(m) == fresh()
    with m.exclusively(), pytest.raises(RuntimeError):
        m.update()


def test_configurations_and_empty_books_and_zips(spark, tmp_path):
    root = corpus.write(tmp_path)
    m = Maintainer(spark, root, str(tmp_path / "store"))
    m.rebuild()
    folder = tmp_path / "corpora" / "small"
    lemmas = lambda c="small": {r[0] for r in m.tables()[1].where(f"corpus_id = '{c}'").select("lemma").distinct().collect()}
    assert "the" not in lemmas() and "river" in lemmas()
    # a second corpus with words of its own to ignore: those of the first stay in it
    (tmp_path / "corpora" / "other").mkdir()
    (tmp_path / "corpora" / "other" / "a.usfm").write_text("\\id GEN\n\\c 1\n\\p\n\\v 1 the river Für Elise")
    (tmp_path / "corpora" / "other" / "corpus.toml").write_text('[search]\nignored_words = ["für"]')
    m.update()
    assert lemmas("other") == {"the", "river", "elise"} and "the" not in lemmas()
    # what the index depends on makes it anew; what it does not leaves it
    (folder / "corpus.toml").write_text(corpus.CONFIG.replace('["the", "The", "a"]', '["river"]'))
    assert m.update() == set() and "the" in lemmas() and "river" not in lemmas()
    (folder / "corpus.toml").write_text("[search]\nindex = false")
    assert m.update() == set() and lemmas() == set() and m.tables()[0].where("corpus_id = 'small'").count() > 0
    (folder / "corpus.toml").unlink()
    m.update()
    assert {"the", "river"} <= lemmas()
    # a book that loses its words loses its postings
    (folder / "02-EXO.usfm").write_text("\\id EXO\n\\c 1\n\\p\n")
    assert m.update() == {("small", 1)} and m.tables()[1].where("corpus_id = 'small' and book_ord = 1").count() == 0
    with zipfile.ZipFile(f"{root}/packed.zip", "w") as z:
        z.writestr("x/1.usfm", "\\id RUT\n\\c 1\n\\p\n\\v 1 gleaning")
        z.writestr("2.usfm", "\\id JON\n\\c 1\n\\p\n\\v 1 a fish")
    assert m.update() == {("packed", 7), ("packed", 31)} and lemmas("packed") == {"gleaning", "a", "fish"}
    (tmp_path / "corpora" / "packed.zip").unlink()
    assert m.update() == {("packed", 7), ("packed", 31)} and lemmas("packed") == set()
    fresh = Maintainer(spark, root, str(tmp_path / "fresh"))
    fresh.rebuild()
    key = lambda t: sorted(map(str, t[1].select("corpus_id", "book_ord", "lemma", "pos").collect()))
    assert key(m.tables()) == key(fresh.tables())


def test_watch(spark, tmp_path):
    root = corpus.write(tmp_path)
    m = Maintainer(spark, root, str(tmp_path / "store"))
    m.rebuild()
    (tmp_path / "corpora" / "small" / "03-LEV.usfm").write_text("\\id LEV\n\\c 1\n\\p\n\\v 1 new words")
    m.watch(str(tmp_path / "state"), once=True).awaitTermination()
    assert m.tables()[1].where("lemma = 'words'").count() == 1


def test_note_labels(engine):
    assert [(r["note_no"], r["label"]) for r in nd.note_labels(engine.nodes).collect()] == [(1, "a")]
    histogram = {r["marker_or_type"]: r["n"] for r in nd.marker_histogram(engine.nodes).collect()}
    assert (histogram["v"], histogram["c"], histogram["f"]) == (8, 4, 1)
    assert [(r["book_ord"], r["n"]) for r in nd.unsupported(engine.nodes, [m for m in histogram if m != "q1"]).collect()] == [(0, 1)]


def test_a_chapter_number_that_comes_twice(spark):
    """A reference names the first chapter of its number; a verse that only the later one has is none."""
    from pyspark.sql import functions as F

    from lectern.operators import nodes as nd
    from lectern.operators import passages

    text = "\\id GEN\n\\c 3\n\\p\n\\v 1 a\n\\v 2 b\n\\c 4\n\\p\n\\v 1 c\n\\c 3\n\\p\n\\v 1 d\n\\v 2 e\n\\v 3 f\n\\v 4 g"
    n = nd.nodes(nd.parse_files(spark.createDataFrame([("a", "1.usfm", "usfm", text)], "corpus_id string, path string, kind string, text string")))
    wanted = spark.createDataFrame([(2, 2), (4, 4)], "v_first int, v_last int").select(F.col("v_first").alias("req_id"), F.lit("a").alias("corpus_id"), F.lit(0).alias("book_ord"), F.lit(3).alias("chapter"), "v_first", "v_last")
    found = [(r["req_id"], tuple(r["start_at"]), tuple(r["end_at"])) for r in passages.bounds(n, wanted).collect()]
    assert found == [(2, (2, 2), (3, 0))]
