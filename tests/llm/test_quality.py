from __future__ import annotations

import zlib

import numpy as np

from lectern.llm import quality
from lectern.llm.queries import op4_quality


def test_held_out_accuracy_and_folds(spark, sf):
    rows = op4_quality(spark, sf).collect()
    assert len(rows) == 127
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
    held = [(r["doc_id"], r["score"]) for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 120]
    bad = [s for i, s in held if i % 8 == 0]
    good = [s for i, s in held if i % 8 != 0]
    assert bad and good and max(bad) < min(good)


def test_labels_of_the_held_out_fold_have_no_part(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.offset) == (b.slope, b.offset)


def test_edges(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "w " * 100_000)])
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_documents(docs, empty).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.score_documents(docs, one).collect()) == 6
    assert quality.score_documents(make_docs([]), one).collect() == []
    clash = docs.withColumnsRenamed({"lang": "score", "source": "row"})
    assert quality.keep_good(clash, empty).columns == clash.columns


def test_dual_coordinate_descent_parts_separable_rows():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    y = np.array([1.0, 1.0, 0.0, 0.0])
    w = quality.dual_coordinate_descent(rows, [np.ones(2)] * 4, y, np.ones(4), 2, 50)
    margin = [w[x].sum() + w[-1] for x in rows]
    assert margin[0] > 0.9 and margin[1] > 0.9 and margin[2] < -0.9 and margin[3] < -0.9


def plain_indicators(text, bits):
    """The columns of a text, n-gram by n-gram, in integers."""
    import re

    import xxhash

    full, out, last, kinds = 1 << 64, set(), None, []

    def column(x):
        x %= full
        return (((x ^ x >> 29) * 0xBF58476D1CE4E5B9) % full) >> (64 - bits)

    for word in (text or "").split():
        forms = []
        for part in re.findall(r"[^\W\d_]+|\d+|\s+|[\W_]", word):
            form = "0" if part.isdigit() else part if not part.isalpha() else "Aa" if part[0].isupper() and part[1:].islower() else "A" if part.isupper() else "a"
            forms += [form] if forms[-1:] != [form] else []
        code = xxhash.xxh64_intdigest(word.lower().strip(".,!?")) >> 16 << 16 | xxhash.xxh64_intdigest("".join(forms)) % 65536
        out.add(column(code >> 16))
        kinds.append(code % 65536 * 2 + (code == last))
        last = code
    for i, k in enumerate(kinds):
        out.add(column(k + 2**50))
        if i + 1 < len(kinds):
            two = k * 0x9E3779B97F4A7C15 + kinds[i + 1]
            out.add(column(two + 2**51))
            if i + 2 < len(kinds):
                out.add(column(two * 0xC2B2AE3D27D4EB4F + kinds[i + 2]))
    return sorted(out)


def test_scores_match_a_plain_version(spark, sf):
    """Indicators in integers; ratios from counts in dictionaries; the hinge-loss fit holds its optimality conditions; scores by hand."""
    import math

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = quality.Words()
    for _, text in [*docs, (0, "MiXed Case-42 x_9 ½ ＡＢ a a a, A.")]:
        assert quality.indicators(text, words).tolist() == plain_indicators(text, quality.BITS)
    own = [(i, t) for i, t in docs if i is not None and i < 120 and not (i in (7, 8))]
    rows, y = [np.array(plain_indicators(t, quality.BITS)) for _, t in own], np.array([float(i % 8 != 0) for i, _ in own])
    counts = [{}, {}]
    for x, label in zip(rows, y, strict=True):
        for c in x:
            counts[int(label)][c] = counts[int(label)].get(c, 0) + 1
    total = [sum(c.values()) + (1 << quality.BITS) for c in counts]
    ratio = {c: math.log((counts[1].get(c, 0) + 1) / total[1]) - math.log((counts[0].get(c, 0) + 1) / total[0]) for c in {*counts[0], *counts[1]}}
    found = quality.log_count_ratios(rows, y, quality.BITS)
    assert all(abs(found[c] - v) < 1e-9 for c, v in ratio.items()) and not found[[c for c in range(100) if c not in ratio]].any()
    values = [np.array([ratio[c] for c in x]) / math.sqrt(len(x)) for x in rows]
    cost = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = quality.dual_coordinate_descent(rows, values, y, cost, quality.BITS, 300)
    margin = np.array([sum(w[c] * v for c, v in zip(x, own_values, strict=True)) + w[-1] for x, own_values in zip(rows, values, strict=True)]) * (2 * y - 1)
    primal = float(w @ w) / 2 + float((cost * np.maximum(0, 1 - margin)).sum())
    assert primal <= 1.001 * min(primal, *(float((w * k) @ (w * k)) / 2 + float((cost * np.maximum(0, 1 - margin * k)).sum()) for k in (0.9, 0.99, 1.01, 1.1)))
    model = quality.train(rows, [int(v) for v in y])
    for x in rows[:20]:
        z = model.slope * (sum(float(model.weights[c]) for c in x) / math.sqrt(len(x)) + model.bias) + model.offset
        assert abs(model.probability(x) - 1 / (1 + math.exp(-z))) < 1e-6
