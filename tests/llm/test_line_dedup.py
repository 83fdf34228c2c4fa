from __future__ import annotations

from collections import defaultdict

from lectern.llm import line_dedup
from lectern.llm.common import BLANKS


def brute(rows, min_chars=40, min_docs=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    keep = {k: max(v, key=lambda x: (x is not None, x or 0)) for k, v in holders.items() if len({x for x in v if x is not None}) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in keep and keep[key(x)] != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(df):
    return sorted(((r["doc_id"], r["text"], r["line_stats"]["n_lines"], r["line_stats"]["n_dropped"]) for r in line_dedup.dedup_lines(df).collect()), key=str)


def test_matches_brute_force(make_docs):
    a, b = "A common line that many documents hold, word for word", "Another line, somewhat longer than forty characters"
    rows = [(i, f"Own {i}\n{a if i % 2 else a.upper()} \n{b if i % 3 == 0 else 'x'}\n\t{a}") for i in range(14)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, a), (23, a), (24, "É" * 45), (25, "é" * 45)] + [(30 + i, "É" * 45 + "\n" + "ab" * 19) for i in range(6)]
    rows += [(40, "\n".join([a, "short", b] * 3000))]
    assert run(make_docs(rows)) == brute(rows)


def test_repeated_ids_count_once(make_docs):
    line = "this very line is repeated by the same document only"
    assert run(make_docs([(1, line)] * 9)) == [(1, line, 1, 0)] * 9


def test_null_ids_and_clashing_columns(spark, make_docs):
    line = "a line of forty characters and some more of them"
    df = make_docs([(None, line)] + [(i, line) for i in range(6)]).withColumnsRenamed({"lang": "line_stats", "source": "row"})
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "row", "n_chars", "line_stats"]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(None, ""), *((i, "") for i in range(5)), (5, line)], key=str)
    assert run(make_docs([])) == []
