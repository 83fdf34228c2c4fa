from __future__ import annotations

import numpy as np
import public_tokenizers
import test_jaccard_join
import test_line_dedup
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import decontaminate, quality


def test_stages_match_brute_force(spark, sf):
    """The classifier's decisions are taken as they are (its own test holds them); every later stage is worked out by hand."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = quality.keep_good(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert 100 < len(rows) < 127
    rows = [(i, t) for i, t, _, _ in test_line_dedup.brute(rows)]
    component = {(i, n, c) for i, n, c in test_jaccard_join.brute(rows)}
    gone = {i for i, _, c in component if i is not None and i != c}
    rows = [(i, t) for i, t in rows if i is None or i not in gone]
    matcher = decontaminate.Matcher([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    rows = [(i, t) for i, t in rows if not matcher.matches(t)]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(i), len(x), sum(x)) for i, t in rows for x in [[*tok.encode(t, add_special_tokens=False).ids, 1]])
    got: dict = {}
    out = corpus_pipeline.run(spark, sf).collect()
    total: dict = {}
    for r in out:
        ids = np.frombuffer(r["ids"], dtype="<u4")
        total.setdefault((r["doc_id"], r["doc_tokens"]), []).append(int(ids.sum()))
    del got
    assert sorted((str(i), n) for i, n in total) == sorted({(i, n) for i, n, _ in want})
    assert sum(map(sum, total.values())) == sum(s for _, _, s in want)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert (name, out.columns) == (name, docs.columns)
        assert stage(spark, docs.limit(0), sf).collect() == []
