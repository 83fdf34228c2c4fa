"""Token files: the same ids as the library gives, a grammar that loses nothing, and reading by place."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import token_files as tf


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tf.default_tokenizer())


def test_ids_are_the_library_s(library):
    """Whole odd texts: contractions, numbers, signs, accents apart and composed, capitals that fold oddly, other scripts, added tokens, control characters."""
    r = random.Random(1)
    bits = ["don't", "We'LL", "'second", "''s", "x'", "1234", "½²", "a1b22", "Été", "été", "ſtraße", "İstanbul", "ıΣΑΣ", "漢字", "ไทย", "<|endoftext|>", "<|", "a<|startoftext|>b", "\x1c", "\x00", "\x7f", " ", " ", "　", "—", "…", "€5", "ªº", "J̌", "__init__", "...", "'re've", "\t\n\r", "😀", "word", "The"]
    model = tf.bpe(tf.default_tokenizer())
    texts = [*bits, "", *("".join(r.choice(bits) + r.choice(["", " ", "\n", "  "]) for _ in range(r.randint(1, 30))) for _ in range(3000))]
    for t in texts:
        assert np.frombuffer(model.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    every = "".join(chr(c) + " a" for c in range(1, 0x2100))
    assert np.frombuffer(model.ids(every), "<u4").tolist() == library.encode(every, add_special_tokens=False).ids
    for c in range(1, 0x2100):
        t = f"x{chr(c)}y {chr(c)}{chr(c)}1 '{chr(c)}s"
        assert np.frombuffer(model.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, hex(c)


def row(docs: list[list[int]]) -> dict:
    return tf.shard_row(0, 0, 0, list(range(len(docs))), [np.array(d, dtype="<u4").tobytes() for d in docs])


@given(st.lists(st.lists(st.sampled_from([1, 2, 3, 70_000, 2**31]), min_size=1, max_size=80), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_grammar_round_trip(docs):
    """Runs of one id, ids that the end id equals, ids beyond 2^24: whole, by document and by place."""
    s = tf.Shard(row(docs))
    ids = [i for d in docs for i in d]
    assert s.expand(s.symbols).tolist() == ids
    assert [s.document(k).tolist() for k in range(len(docs))] == docs
    for a in range(0, len(ids) + 2, 7):
        for b in (a, a + 1, a + 13, len(ids)):
            assert s.between(a, b).tolist() == ids[a:b]


def test_grammar_is_re_pair():
    """Rules name earlier symbols, lengths add up, a repeated text costs few symbols, and no frequent pair is left over."""
    r = random.Random(2)
    phrase = [r.randrange(5, 900) for _ in range(64)]
    docs = [[*phrase, r.randrange(5, 900), 1] for _ in range(400)]
    x = row(docs)
    s = tf.Shard(x)
    assert s.expand(s.symbols).tolist() == [i for d in docs for i in d]
    assert len(s.symbols) < 400 * 66 / 10
    size = len(s.alphabet)
    for k, (a, b) in enumerate(s.rules.tolist()):
        assert max(a, b) < size + k
        assert s.lengths[size + k] == s.lengths[a] + s.lengths[b]
    assert s.lengths.max() == 64 or s.lengths.max() >= 32


def test_long_runs_and_wide_symbols():
    """A run of one id becomes a chain of doublings; more than 65,536 different ids take four bytes each."""
    s = tf.Shard(row([[7] * 100_000]))
    assert len(s.symbols) < 1000 and s.expand(s.symbols).tolist() == [7] * 100_000
    many = list(range(70_000)) + [1, 2] * 50
    w = tf.Shard(row([many]))
    assert w.symbols.dtype.itemsize == 4 and w.expand(w.symbols).tolist() == many


def plain(rows, library):
    """Documents in order of id; equal ids in any order of texts, as their hash decides."""
    at, out = 0, []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((i, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    return out


def test_files_against_plain(spark, make_docs, library, monkeypatch, tmp_path):
    """Small shards, several tasks, nulls, empty and very long texts, extra columns; read from a folder; ids by place over shard bounds."""
    monkeypatch.setattr(tf, "SHARD_IDS", 200)
    r = random.Random(4)
    rows = [(i * 37 % 1000, " ".join(r.choice("the of and don't Straße 42 x".split()) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(5000, None), (5001, ""), (5002, "many words " * 60_000), (None, "nobody's")]
    docs = make_docs(rows).selectExpr("*", "1 AS task", "2 AS start", "3 AS ids").repartition(5)
    shards, manifest = tf.write(docs, str(tmp_path / "files"), tasks=4)
    want = plain(rows, library)
    got = sorted(map(tuple, tf.documents(shards, manifest, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda x: x[1])
    assert got == want
    again = tf.documents(*tf.read(spark, str(tmp_path / "files"))).collect()
    flat = [i for d in sorted(again, key=lambda x: x["start"]) for i in d["ids"]]
    assert len(flat) == sum(w[2] for w in want) and shards.count() > 20
    ranges = [(k, a, a + n) for k, (a, n) in enumerate([(0, 1), (150, 400), (900, 0), (1000, 2500), (len(flat) - 3, 10), (len(flat) + 5, 5)])]
    found: dict = {}
    for x in sorted(tf.ids_between(shards, manifest, spark.createDataFrame(ranges, "range_id long, start long, stop long")).collect(), key=lambda x: x["start"]):
        found.setdefault(x["range_id"], []).extend(x["ids"])
    assert found == {k: flat[a:b] for k, a, b in ranges if flat[a:b]}


def test_equal_ids_and_no_rows(make_docs, library):
    rows = [(7, "one"), (7, "one"), (7, "two words"), (3, "a"), (None, None)]
    out = sorted(map(tuple, tf.documents(*tf.write(make_docs(rows)), with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda x: x[1])
    assert sorted((x[0] or -1, x[2], x[3]) for x in out) == sorted((x[0] or -1, x[2], x[3]) for x in plain(rows, library))
    assert [x[0] for x in out] == [None, 3, 7, 7, 7] and all(a[1] + a[2] == b[1] for a, b in zip(out, out[1:], strict=False))
    assert tf.documents(*tf.write(make_docs([]))).collect() == []
