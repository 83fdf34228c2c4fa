"""Phrases told by joins, as PhraseBook tells them, and rules that hold over spans, against all rules at all places."""

from __future__ import annotations

import random

import pytest

from lectern.config import FootnoteRule
from lectern.operators import intervals, phrases
from lectern.operators.footnotes import PhraseBook

REF = "struct<book_ord: bigint, chapter: int, v_first: int, v_last: int>"
RULES = f"lemma string, low {REF}, high {REF}, priority int, note string"
PLACES = "lemma string, book_ord bigint, chapter int, v_first int, v_last int, k int"


def stretches(spark, texts):
    rows = [(i, k, w, len(x) - 1) for i, x in enumerate(texts) for k, w in enumerate(x)]
    return spark.createDataFrame(rows, "doc int, pos int, lemma string, last_pos int")


def table_of(spark, names):
    return spark.createDataFrame([(list(p),) for p in names], "phrase array<string>")


@pytest.mark.parametrize("seed", range(3))
def test_told_as_the_phrase_book_tells(spark, seed):
    r = random.Random(seed)
    names = {tuple(r.choices("abc", k=r.randint(1, 4))) for _ in range(6)}
    book = PhraseBook([FootnoteRule(p, (0, 0, 0, 0), (9, 0, 0, 0), "n", 0) for p in names])
    texts = [r.choices("abcd", k=r.randint(0, 16)) for _ in range(300)] + [["a"] * 400, ["a", "b"] * 300]
    want = sorted((i, a, b - a, " ".join(x[a:b])) for i, x in enumerate(texts) for a, b in book.told(x))
    assert sorted(map(tuple, phrases.told(stretches(spark, texts), table_of(spark, names), ["doc"]).collect())) == want and want


def test_no_phrases_and_no_words(spark):
    assert phrases.told(stretches(spark, [["a", "b"]]), table_of(spark, []), ["doc"]).collect() == []
    assert phrases.told(stretches(spark, []), table_of(spark, [("a",)]), ["doc"]).collect() == []
    assert phrases.told(stretches(spark, [["a"]]), table_of(spark, [("a",), ("a",), ()]), ["doc"]).count() == 1


def check_rules(spark, rows, rules):
    want = []
    for x in rows:
        holds = [q for q in rules if q[0] == x[0] and None not in q[1] + q[2] + x[1:5] and q[1] <= x[1:5] <= q[2]]
        if holds:
            want.append((x[5], max(holds, key=lambda q: (q[3], q[4]))[4]))
    got = intervals.holding(spark.createDataFrame(rows, PLACES), spark.createDataFrame(rules, RULES), ["lemma"])
    assert sorted((g["k"], g["note"]) for g in got.collect()) == sorted(want)
    return len(want)


@pytest.mark.parametrize("top", [2, 5, 60])
def test_spans(spark, top):
    """Ends that part at every number, empty and endless spans, overlaps of any kind."""
    r = random.Random(top)
    number = lambda: r.randint(0, top)
    rules = [(r.choice("ab"), tuple(number() for _ in range(4)), tuple(number() if r.random() < 0.8 else 2**31 - 1 for _ in range(4)), k // 2, f"n{k:03}") for k in range(80)]
    rows = [(r.choice("abc"), *[r.randint(0, top + 2) for _ in range(4)], k) for k in range(1500)] + [("a", 10**9, 1, 1, 1, 9001), ("a", 0, 2**31 - 1, 0, 0, 9002)]
    assert check_rules(spark, rows, rules) > 100


def test_odd_rules(spark):
    everywhere = ("a", (0, 0, 0, 0), (2**31 - 1,) * 4, 0, "all")
    rows = [("a", 5, 1, 1, 1, 1), ("a", None, 1, 1, 1, 2), ("a", 2**31 - 1, 0, 0, 0, 3), ("b", 5, 1, 1, 1, 4)]
    check_rules(spark, rows, [everywhere])
    check_rules(spark, rows, [everywhere, ("a", (5, 1, 1, 1), (5, 1, 1, 1), 1, "one"), ("a", (6, 0, 0, 0), (4, 0, 0, 0), 2, "none"), ("a", (None, 0, 0, 0), (9, 0, 0, 0), 3, "null")])
    check_rules(spark, rows, [])
    check_rules(spark, [], [everywhere])


def test_a_hundred_thousand_rules(spark):
    """Many rules on few words: whichever holds is found, and no place meets more than its pieces."""
    from pyspark.sql import functions as F

    n = 100_000
    place = lambda book, verse: F.struct(book.cast("long").alias("book_ord"), F.lit(1).alias("chapter"), verse.cast("int").alias("v_first"), verse.cast("int").alias("v_last"))
    k = F.col("id")
    rules = spark.range(n).select((k % 3).cast("string").alias("lemma"), place(k % 500, k % 90).alias("low"), place(k % 500 + k % 4, k % 70 + 5).alias("high"), k.alias("priority"), k.cast("string").alias("note"))
    rows = spark.range(6000).select((k % 3).cast("string").alias("lemma"), (k % 500).alias("book_ord"), F.lit(1).alias("chapter"), (k % 100).cast("int").alias("v_first"), (k % 100).cast("int").alias("v_last"), k.alias("k"))
    got = {x["k"]: int(x["note"]) for x in intervals.holding(rows, rules, ["lemma"]).collect()}
    by_word: dict = {}
    for i in range(n):
        by_word.setdefault(i % 3, []).append(((i % 500, i % 90), (i % 500 + i % 4, i % 70 + 5), i))
    for j in range(0, 6000, 97):
        at = (j % 500, j % 100)
        best = max((i for low, high, i in by_word[j % 3] if low <= at <= high), default=None)
        assert got.get(j) == best
    assert len(got) > 5000
