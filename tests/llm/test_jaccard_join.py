from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lectern.llm import components, jaccard_join as j


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def run(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.join_components(df).collect()), key=str)


def make_rows(seed: int, groups: int = 12):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice([3, 6, 8, 20, 60, 200]))]
        if r.random() < 0.4:
            base = base[: max(2, len(base) // 6)] + passage
        for _ in range(r.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                k = r.randrange(len(w))
                w[k : k + 1] = [word()] if r.random() < 0.6 else []
                w = w or [word()]
            rows.append(" ".join(w) if r.random() < 0.5 else "\t ".join(x.upper() for x in w))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(make_docs, seed):
    rows = make_rows(seed)
    assert run(make_docs(rows)) == brute(rows)


def test_frequent_tokens_and_hot_signatures(make_docs, monkeypatch):
    """With every token frequent and lanes of two, links still join as they should."""
    monkeypatch.setattr(j, "FREQUENT_TIMES", 0)
    monkeypatch.setattr(j, "FREQUENT_LEAST", 0)
    rows = make_rows(7)
    assert run(make_docs(rows)) == brute(rows)


def test_signatures_meet_for_every_linked_pair():
    r = np.random.default_rng(3)
    for _ in range(400):
        n = int(r.integers(2, 300))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(r.integers(0, max(1, len(a) // 4) + 1))
        b = np.unique(np.concatenate([a[r.permutation(len(a))[drop:]], r.integers(0, 1 << 63, int(r.integers(0, 6)), dtype=np.uint64)]))
        if not len(b):
            continue
        both, either = j.similarity(a, b)
        if 100 * both < 75 * either or both == either:
            continue
        freq = lambda x: (x % np.uint64(5)).astype(np.int64) * 40
        for limit in (-1, 60, 1000):
            s, t = (j.signatures(x, freq(x), limit, 75)[0] for x in (a, b))
            assert len(np.intersect1d(s, t)), (len(a), len(b), limit)
        assert j.may_link(j.bitmap(a), len(a), j.bitmap(b), len(b), 75)


def test_words_hash_by_content():
    w = j.WordHash(0)
    one, two, three = w(b"ab cd  ab\x0bcd\n"), w(b"cd"), w(b"x" * 300 + b" " + b"x" * 300)
    assert one[0] == one[2] and one[1] == one[3] == two[0] and three[0] == three[1] and len(w(b"\t ")) == 0


def test_edges(make_docs):
    t = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "few words"), (5, "FEW  words"), (6, t), (6, t), (6, "something else entirely, in other words here"), (None, t), (None, "a null id alone"), (9, "x y z " * 40_000), (3, t + " eight")]
    df = make_docs(rows).withColumnsRenamed({"lang": "node", "source": "component_id"})
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == []
    assert run(make_docs([(1, None), (2, "")])) == [(1, 0, 1), (2, 0, 2)]


def test_keep_one(make_docs):
    t = "one two three four five six seven"
    rows = [(5, t), (2, t.upper()), (7, None), (8, ""), (None, t), (9, "quite another text of some words"), (5, "a clean text under an id that repeats, with words of its own")]
    rows += [(11, "this row is there twice, as it is, in every column")] * 2 + [(None, "and so is this one, which has no id at all")] * 3
    kept = j.keep_one(make_docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = [(2, t.upper()), (5, rows[6][1]), (7, None), (8, ""), (9, rows[5][1]), (11, rows[7][1]), (None, rows[9][1])]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_many_null_ids_and_a_hot_set(make_docs):
    """Ten thousand rows without an id, a third of all rows one set: no join multiplies them."""
    t = "the same words again and again in every row of this group"
    rows = [(None, f"{t} {i % 50}") for i in range(6000)] + [(None, t)] * 4000 + [(i, t) for i in range(5000)]
    out = j.join_components(make_docs(rows)).collect()
    assert len(out) == 15_000 and {r["component_id"] for r in out} == {0}
    assert [r["doc_id"] for r in j.keep_one(make_docs(rows)).collect()] == [0]


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(7, 7)]
    got = {(r["node"], r["root"]) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 100) for i in range(101, 161)} | {(k, 1) for k in range(2, 40)}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []
