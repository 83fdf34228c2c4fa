from __future__ import annotations

import random

from lectern.llm import decontaminate as d


def edit_distance_within(pattern: str, text: str) -> tuple[int, int]:
    row = list(range(len(pattern) + 1))
    best, end = row[-1], 0
    for at, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (p != c)))
        row = new
        if row[-1] < best:
            best, end = row[-1], at
    return best, end


def test_myers_matches_the_table():
    r = random.Random(4)
    for _ in range(400):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 120)))
        assert d.myers(d.bits_of(p), len(p), t) == edit_distance_within(p, t)


def mutate(r: random.Random, s: str, k: int) -> str:
    chars = list(s)
    for _ in range(k):
        i, how = r.randrange(len(chars)), r.random()
        if how < 0.4:
            chars[i] = r.choice("xyzq")
        elif how < 0.7:
            del chars[i]
        else:
            chars.insert(i, r.choice("xyzq"))
    return "".join(chars)


def test_finds_what_the_table_finds():
    r = random.Random(6)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    items = [(i, words(20)) for i in range(8)]
    matcher = d.Matcher(items)
    for _ in range(120):
        item = r.choice(items)
        text = f"{words(30)}. {mutate(r, item[1], r.randint(0, 12))}, {words(30)}"
        t = d.normalise(text)
        want = {i for i, p in items if edit_distance_within(d.normalise(p), t)[0] <= int(len(d.normalise(p)) * d.RATE)}
        found = {m["item_id"]: m for m in matcher.matches(text)}
        assert set(found) == want
        for i in want:
            assert found[i]["distance"] == edit_distance_within(d.normalise(dict(items)[i]), t)[0]


def test_places_are_of_the_text():
    item = "The quick brown fox jumps over the lazy dog again and again"
    text = "Well --  THE QUICK\tbrown fox, jumps over the lazy dog; again and again!! İ end"
    (m,) = d.Matcher([(3, item)]).matches(text)
    assert (m["distance"], text[m["start"] : m["end"]]) == (0, "THE QUICK\tbrown fox, jumps over the lazy dog; again and again")


def test_tables(spark, sf, make_docs):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, items).collect()}
    assert found == {(i, i % 6) for i in range(120) if i % 8 == 4}
    clean = d.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 15


def test_edges(spark, make_docs):
    whole = "some words that are the item itself here"
    docs = make_docs([(1, None), (2, ""), (None, whole), (3, "x " * 100_000), (5, "Yes!"), (6, "yes, the x x and no")]).withColumnsRenamed({"lang": "found", "source": "row"})
    items = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (None, "x x"), (4, whole), (4, whole), (None, whole), (7, "Yes"), (8, "The")], "item_id long, text string")
    want = [(None, 4), (None, 4), (None, None), (5, 7)]
    assert sorted(((r["doc_id"], r["item_id"]) for r in d.contaminated(docs, items).collect()), key=str) == sorted(want, key=str)
    assert sorted(r["doc_id"] for r in d.clean(docs, items).collect()) == [1, 2, 3, 6]
    assert d.clean(docs, items.limit(0)).count() == 6 and d.contaminated(docs, items.limit(0)).collect() == []
    assert d.contaminated(docs.limit(0), items).collect() == []


def test_blocks_of_items(spark, sf, monkeypatch):
    """A benchmark of many blocks gives what one block gives."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found, clean = sorted(map(tuple, d.contaminated(docs, items).collect())), d.clean(docs, items).count()
    monkeypatch.setattr(d, "BLOCK_CHARS", 300)
    assert len(list(d.item_blocks(items, "item_id", "text"))) > 2
    assert sorted(map(tuple, d.contaminated(docs, items).collect())) == found and d.clean(docs, items).count() == clean
