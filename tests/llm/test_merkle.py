"""The Merkle manifest against a plain tree, with few and many levels, hot groups and odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from lectern.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp long"


def digest(s: bytes | str) -> str:
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def leaf(row) -> str:
    return digest(b"".join(b"-" if v is None else f"{len(str(v).encode())}:{v}".encode() for v in row))


def tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        run = level[i // 3 * 3 :][:3]
        out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return out


def plain(rows: list[tuple]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in groups[k]]) for k in keys]
    top = tree([t[-1][0] for t in trees]) if keys else []
    out = []
    for s, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            proof = path(trees[s], i) + path(top, s)
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf((*r[:4], r[4].replace("\n", ""))) if tampered else leaf(r)
            for a, b in proof:
                h = digest(a + h + b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in proof)), h, h == top[-1][0]))
    return sorted(out, key=str)


def check(spark, rows: list[tuple]) -> list[tuple]:
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS)
    out = merkle.verify(docs)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == plain(rows)
    return got


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_trees_of_all_heights(spark, monkeypatch, levels):
    """Groups of 1, 2, 3, 4, 27, 28 and 100 leaves, and a group with most of all rows; with low blocks a proof takes several rounds."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    r = random.Random(3)
    sizes = {"é": 1, "b": 2, "Z": 3, None: 4, "": 27, "c": 28, "d": 100, "hot": 330}
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n * 7 % 1009, source, r.choice(["en", None]), r.choice([None, n]), r.choice(["a\nb", "ü", "", None, "x\n\n", "plain " * r.randint(1, 40)])))
    got = check(spark, rows)
    assert {g[-1] for g in got} == {True, False}


def test_odd_rows(spark):
    """Nulls in all fields, rows that repeat whole, equal ids, a very long text."""
    same = (5, "s", "en", 3, "a\nb")
    check(spark, [same, same, same, (5, "s", "en", 3, "other"), (None, None, None, None, None), (None, None, None, None, None), (None, "s", None, 0, ""), (-3, "s", "de", -1, "word \n" * 300_000)])


def test_one_row_and_none(spark):
    (only,) = check(spark, [(1, "s", "en", 1, "a")])
    assert only[1] == only[2] == only[3] and only[4] == digest("") and only[6]
    assert check(spark, []) == []


def test_many_groups(spark):
    """More groups than a block has nodes: the upper tree takes two rounds."""
    check(spark, [(i, f"s{i % 800}", "en", i, "a\nb") for i in range(1000)])


def test_what_tampering_cannot_hide(spark):
    """Another root for any other field, order or row."""
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(20)]
    of = lambda rs: merkle.root_of(merkle.document_leaves(spark.createDataFrame([(*r, "x", 1) for r in rs], COLUMNS)))
    base = of(rows)
    assert base == of(rows[::-1])
    changed = [rows[:-1], [*rows, rows[0]], [(99, *rows[0][1:]), *rows[1:]], [(*rows[0][:3], 2, rows[0][4]), *rows[1:]], [(0, "s", None, 1, "text 0"), *rows[1:]]]
    roots = [of(c) for c in changed]
    assert len({base, *roots}) == len(changed) + 1
