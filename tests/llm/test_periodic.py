"""Periodic runs against all lags and places, with heavy and light words, and against texts that repeat in known ways."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import periodic as P


def smallest_period(s: list) -> int:
    return next(q for q in range(1, len(s) + 1) if all(s[i] == s[i + q] for i in range(len(s) - q)))


def plain(w: list) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q) and smallest_period(w[i : j + q]) == q:
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def of(texts: list[list[int]]) -> list:
    return P.many_runs([np.array(t, dtype=np.int64) for t in texts])


blocks = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 60)).map(lambda x: (x[0] * 60)[: x[1]])


@pytest.mark.parametrize("heavy, cost", [(64, 12), (2, 0.001)])
def test_runs(heavy, cost):
    """Many texts at once, all words light, then all heavy."""

    @given(st.lists(st.lists(blocks, max_size=5).map(lambda bs: [w for b in bs for w in b]), min_size=1, max_size=6))
    @settings(max_examples=150, deadline=None)
    def check(texts):
        assert of(texts) == [plain(t) for t in texts]

    was = P.HEAVY, P.PAIR_COST
    P.HEAVY, P.PAIR_COST = heavy, cost
    try:
        check()
    finally:
        P.HEAVY, P.PAIR_COST = was


def test_counts_by_fft_and_by_pairs():
    """Both ways of counting give the matches at each lag."""
    r = np.random.default_rng(3)
    text = np.minimum(r.zipf(1.4, 3000), 500).astype(np.int64)
    want = np.array([0] + [(text[:-q] == text[q:]).sum() for q in range(1, 751)])
    assert (P.lag_counts([text])[0] == want).all()
    heavy = P.heavy_counts(text, np.arange(text.max() + 1), 750)
    assert (heavy[1:] == want[1:]).all()


def test_long_texts():
    """A hundred thousand words: one word, two words by turns, a period near a quarter, random words, a run inside others."""
    n = 100_000
    r = np.random.default_rng(5)
    block = r.integers(0, 50, 24_999)
    inner = np.concatenate((r.integers(0, 1000, 500), np.tile(np.concatenate(([1] * 8, [2])), 30), r.integers(0, 1000, 500)))
    same, turns, quarter, noise, nested = of([[0] * n, [0, 1] * (n // 2), np.tile(block, 5)[:n].tolist(), r.integers(0, 10**6, n).tolist(), inner.tolist()])
    assert same == [(0, n, 1)] and turns == [(0, n, 2)] and noise == []
    assert (0, n, 24_999) in quarter
    assert nested == plain(inner.tolist()) and len(nested) == 31


def expected(doc, text) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0 and n:
        g = zlib.crc32(str(doc).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(kept)))


def test_documents(spark, make_docs, monkeypatch):
    """Planted periods, blanks that are no blanks here, nulls, empty and long texts, repeated rows, several batches, extra columns."""
    monkeypatch.setattr(P, "BATCH_WORDS", 500)
    r = random.Random(7)
    rows = []
    for i in range(400):
        words = [r.choice("a b c of the Straße x\xa0y \x1c z z".split(" ")) for _ in range(r.randint(0, 60))]
        rows.append((i, r.choice([" ", "\n", "\t\x0b ", "  "]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (None, "x " * 20), (3, rows[3][1]), (1003, "ab cd " * 4000), (1004, "one " * 6), (1005, "one " * 5)]
    docs = make_docs(rows).selectExpr("*", "1 AS start", "'x' AS runs")
    out = P.find_runs(docs, change=P.plant, with_runs=True, with_text=True)
    got = [tuple(x) for x in out.collect()]
    assert sorted((g[:8] for g in got), key=str) == sorted((expected(*x) for x in rows), key=str)
    assert sum(g[1] > 0 for g in got) > 15
    for g in got:
        assert hashlib.sha256("".join("%d,%d,%d\n" % tuple(x) for x in g[8]).encode()).hexdigest() == g[6]
        assert hashlib.sha256(g[9].encode()).hexdigest() == g[7]


def test_no_rows(make_docs):
    assert P.find_runs(make_docs([])).collect() == []
