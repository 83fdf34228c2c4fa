from __future__ import annotations

import random
import re

import pytest

from lectern.llm import license_scan as s


def grams(t: str) -> list[str]:
    w = re.findall(r"[^\W_]+", t.lower())
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def test_matches_brute_force(make_docs):
    r = random.Random(2)
    names = sorted(s.TEMPLATES)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    rows, want = [], set()
    for i in range(80):
        parts = [words(r.randint(0, 60))]
        for k in r.sample(names, r.randint(0, 2)):
            parts += [s.TEMPLATES[k].upper() if r.random() < 0.3 else s.TEMPLATES[k], words(r.randint(0, 60))]
        text = ".\n".join(parts)
        rows.append((i, text))
        have = set(grams(text))
        want |= {(i, k, len(set(grams(t)) & have) / len(set(grams(t)))) for k, t in s.TEMPLATES.items() if len(set(grams(t)) & have) >= s.CONTAINMENT * len(set(grams(t)))}
    got = {(r["doc_id"], r["license"], r["containment"]) for r in s.scan(make_docs(rows)).collect()}
    assert got == want


def test_bands_retrieve_what_they_promise(make_docs):
    """Notices of every length in long texts, hundreds each: none is lost."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    names = ["MIT-notice", "CC-BY-NC-4.0-notice", "Apache-2.0-notice", "GPL-3.0-notice", "ISC"]
    rows = [(i, " ".join([*(word() for _ in range(r.randint(0, 90))), s.TEMPLATES[names[i % 5]], *(word() for _ in range(r.randint(0, 90)))])) for i in range(1500)]
    assert {(x["doc_id"], x["license"]) for x in s.scan(make_docs(rows)).collect()} >= {(i, names[i % 5]) for i in range(1500)}
    assert all(win - s.N + 1 <= 3 * max(1, n - s.N + 1) for win, _, top in s.lengths(s.TEMPLATES) for n in [min(len(re.findall(r"[^\W_]+", t)) for t in s.TEMPLATES.values() if top >= len(re.findall(r"[^\W_]+", t)) > top * 4 // 5 - 1)])


def test_edges(make_docs):
    t = "intro words " + s.TEMPLATES["MIT-notice"]
    df = make_docs([(1, None), (2, ""), (3, "four words are few"), (4, t), (4, t), (None, t), (5, "a b c d e " * 60_000 + t)]).withColumnsRenamed({"lang": "grams", "source": "copy", "n_chars": "at"})
    got = sorted((str(r["doc_id"]), r["license"], r["first_word"]) for r in s.scan(df).collect())
    assert got == sorted([("4", "MIT-notice", 2), ("4", "MIT-notice", 2), ("None", "MIT-notice", 2), ("5", "MIT-notice", 300_002)])
    assert s.scan(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        s.scan(df, {"short": "four words are few"})
    with pytest.raises(ValueError):
        s.scan(df, {"long": "five " * 200_001})
    assert s.scan(df, {}).collect() == []
