from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lectern.llm import packing
from lectern.llm.queries import op8_packing


def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_library():
    bpe, t, r = packing.ByteBpe(packing.default_tokenizer()), reference(), random.Random(9)
    parts = ["word", "Éa", " ", "  ", "\n", "\n\n", "\t", "it's", "'s", "don't", "12", "3.4", "!!", "###", "$%", "<|endoftext|>", "\xa0", "日本", "\r\n", "_x", "²", "ſ", "é", "\x1c", "😀", "<|endof", "text|>"]
    for _ in range(2000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert np.frombuffer(bpe.ids(s), dtype="<u4").tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)


def test_long_runs():
    bpe, t = packing.ByteBpe(packing.default_tokenizer()), reference()
    for s in (" " * 300_000, "\n" * 200_000, "x" * 100_000, "é" * 50_000, " \n" * 50_000 + "a", "7" * 100_000, "<|endoftext|>" * 5000):
        assert np.frombuffer(bpe.ids(s), dtype="<u4").tolist() == t.encode(s, add_special_tokens=False).ids


def test_cuts():
    for n in range(1, 5000):
        c = packing.cuts(n)
        assert sum(c) == n and all(x & (x - 1) == 0 and x <= 2048 for x in c) and c == sorted(c, reverse=True)
    assert packing.cuts(9, 3) == [2, 2, 2, 2, 1]


def test_round_trip(spark, make_docs):
    t = reference()
    rows = [(1, "Some words here.\nAnd more."), (2, None), (3, ""), (4, "x " * 30_000), (9, "x y " * 800_000), (4, "again"), (4, "again"), (None, "no id")]
    out = packing.pack(make_docs(rows).withColumnsRenamed({"lang": "ids", "source": "length"})).collect()
    assert len({r["sequence_id"] for r in out}) == len(out) and {r["offset"] for r in out} == {0}
    docs = defaultdict(list)
    for r in out:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert len(ids) == r["length"] and r["bucket"] == r["length"].bit_length() - 1
        docs[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
    want = defaultdict(list)
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want[i, len(ids)].append(ids)
    assert set(docs) == set(want)
    for key, pieces in docs.items():
        total = sorted(x for _, ids in pieces for x in ids)
        assert total == sorted(x for ids in want[key] for x in ids)
        if len(want[key]) == 1:
            assert [x for _, ids in sorted(pieces) for x in ids] == want[key][0]


def test_query_and_buckets(spark, sf, tmp_path):
    rows = op8_packing(spark, sf).collect()
    assert all(r["length"] & (r["length"] - 1) == 0 for r in rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    packed = packing.pack(docs)
    assert sorted(r["ids_crc32"] for r in rows) == sorted(zlib.crc32(r["ids"]) for r in packed.collect())
    packing.write_buckets(packed, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b" / "bucket=3")).select("length").distinct().collect()[0][0] == 8
    assert packing.pack(docs.limit(0)).collect() == []
