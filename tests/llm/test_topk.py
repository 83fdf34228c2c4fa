from __future__ import annotations

import math

import numpy as np

from lectern.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        own = min(v for i, v in ok if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(own))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, **kw).collect())


def test_matches_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in r.normal(size=16)]) for i in range(700)]
    rows += [(1000, [None] * 16), (1050, None), (1100, [math.nan] * 16), (1150, [math.inf] * 16), (1200, []), (1250, [1.0, 2.0]), (1251, [1.0, -2.0]), (None, [0.0] * 16)]
    rows += [(701, rows[3][1]), (702, rows[3][1]), (50, rows[50][1]), (50, rows[9][1])]
    assert run(spark, rows) == brute(rows)


def test_ties_few_rows_and_empty(spark):
    rows = [(i, [0.5, 0.5]) for i in range(0, 60)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0]), (3, [1.0])]) == [(0, 1, 3, 65536)]
    assert run(spark, []) == []


def test_bounds_hold_and_save_reads():
    r = np.random.default_rng(2)
    for scale in (1, 40, 10**6):
        vectors = np.floor(256 * r.normal(size=(1024, 64)) * scale / 8).astype(np.int64)
        vectors[:, 5] //= 50
        cells, shift = topk.cells_of(vectors)
        assert (cells.astype(np.int64) << shift <= vectors).all() and (vectors < (cells.astype(np.int64) + 1 << shift)).all()
        queries = vectors[:32]
        edge, gain, loss = topk.bounds(queries, cells, shift)
        exact = queries @ vectors.T
        assert (exact <= edge + gain[:, None]).all() and (exact >= edge + loss[:, None]).all()
        scan = topk.Scan(np.arange(32), queries, 5)
        for at in range(0, 1024, 256):
            scan.meet(np.arange(at, at + 256), np.arange(at, at + 256), cells[at : at + 256], shift)
        rows = [x for f in scan.result() for x in f.itertuples()]
        candidates = {(x.query_id, x.vec_id) for x in rows if x.lower != x.lower}
        assert len(candidates) < 32 * 1024 / 8
        for j in range(32):
            assert all((j, i) in candidates for _, i in sorted((-int(x), i) for i, x in enumerate(exact[j]) if i != j)[:5])


def test_clashing_columns_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_A_BLOCK", 32)
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", 4)
    r = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in r.normal(size=8)]) for i in range(400)] + [(7, [3.0] * 8)] * 9
    df = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<float>, h int, lower double, query_id string")
    assert sorted(tuple(x) for x in topk.top_k(df, every=10).collect()) == brute(rows, every=10)
