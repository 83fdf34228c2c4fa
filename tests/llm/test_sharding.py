from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np

from lectern.llm import sharding
from lectern.llm.queries import op9_sharding


def jump(key: int, n: int) -> int:
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([0, 1, 2, 3, -1, 10**12, 2**63 - 1, -(2**63), *range(100, 1100)], dtype=np.int64)
    for n in (1, 2, 40, 41, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_the_law(spark, sf):
    rows = op9_sharding(spark, sf).collect()
    assert len(rows) == 127
    slots = defaultdict(list)
    for r in rows:
        key = -1 if r["doc_id"] is None else r["doc_id"]
        assert (r["shard"], r["grown_shard"], r["law"]) == (jump(key, 40), jump(key, 41), "key")
        assert r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = {(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows).keys() == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts}


def test_edges(make_docs):
    df = make_docs([(None, None), (None, "a"), (5, "é"), (5, "é")]).withColumnsRenamed({"lang": "shard", "source": "lane", "n_chars": "slot"})
    rows = sharding.shard_rows(df).collect()
    assert len(rows) == 4 and len({(r["shard"], r["slot"]) for r in rows}) == 4
    assert sharding.shard_rows(df.limit(0)).collect() == []


def test_many_lanes_and_a_hot_key(make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "LANE_ROWS", 5)
    rows = sharding.shard_rows(make_docs([(7, "same")] * 700 + [(i, "other") for i in range(800)])).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 1500 and all(sorted(v) == list(range(len(v))) for v in slots.values())
