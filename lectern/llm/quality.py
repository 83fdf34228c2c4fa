"""Quality by naive Bayes support vectors.

A text becomes a set of n-gram indicators: words, and one to three word shapes in a row (what kinds of characters a word is
made of, in order, and whether it repeats the word before). Every indicator is scaled by its log-count ratio between the good and the
bad training texts; a linear hinge-loss model is fitted on the scaled indicators by dual coordinate descent, and its margin
becomes a probability by a logistic curve, fitted on margins of rows left out of each of three fits.

The fit reads a bounded sample of the labelled rows (MAX_SAMPLE, those of the smallest hash, whole texts), whose indicators are made on the
executors; the driver gets those, at most 2**BITS columns a row. The score reads every whole text. Labels never reach a score: rows of the held-out fold are not read by the fit, and neither lang, source
nor doc_id are inputs.

Defined results: a null text is an empty one; an empty text has no indicators but the bias, and a score. Labels that are
null take no part; where labels of an id differ, the lowest counts; an id whose text repeats counts once. Without labels, or with
one class only, every score is the smoothed share of good labels. An empty table gives no rows; a text of any length is a set of at most 2**BITS
indicators; other columns are neither read nor changed, whatever their names. Equal texts have equal scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, lean, ship

FOLDS, CUT = 5, 0.3
#: The bound of the training sample, in rows; the features are hashed to 2**BITS columns.
MAX_SAMPLE, BITS = 4000, 18
CACHE_ENTRIES = 50_000
EPOCHS, COST, SMOOTH = 12, 1.0, 1.0
_KINDS = re.compile(r"[^\W\d_]+|\d+|\s+|[\W_]")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the folds; fold 0 is held out. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")), F.lit(FOLDS))


def shape(word: str) -> str:
    """Runs of upper case, lower case and digits as A, a, 0, a capitalised start as Aa, other characters as they are, once in a row."""
    out = []
    for part in _KINDS.findall(word):
        kind = "0" if part.isdigit() else part if not part.isalpha() else "Aa" if part[:1].isupper() and part[1:].islower() else "A" if part.isupper() else "a"
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


class Words(dict):
    """word -> 64-bit code whose low 16 bits come from its shape."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        code = (xxhash.xxh64_intdigest(word.lower().strip(".,!?")) & ~0xFFFF) | (xxhash.xxh64_intdigest(shape(word)) & 0xFFFF)
        if len(word) <= 64:
            self[word] = code
        return code


def indicators(text: str | None, words: Words, bits: int = BITS) -> np.ndarray:
    """The sorted columns of the n-grams of a text."""
    parts = (text or "").split()
    if not parts:
        return np.zeros(0, dtype=np.int64)
    code = np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=len(parts))
    with np.errstate(over="ignore"):
        again = np.zeros(len(code), dtype=np.uint64)
        again[1:] = code[1:] == code[:-1]
        kind = (code & np.uint64(0xFFFF)) * np.uint64(2) + again
        grams = [code >> np.uint64(16), kind + np.uint64(1 << 50)]
        two = kind[:-1] * np.uint64(0x9E3779B97F4A7C15) + kind[1:]
        grams += [two + np.uint64(1 << 51), two[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + kind[2:]] if len(kind) > 1 else []
        mixed = np.concatenate(grams)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((mixed >> np.uint64(64 - bits)).astype(np.int64))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, bits: int) -> np.ndarray:
    counts = np.zeros((2, 1 << bits))
    for x, label in zip(rows, y, strict=True):
        counts[int(label), x] += 1
    p, q = counts[1] + SMOOTH, counts[0] + SMOOTH
    ratios = np.log((p / p.sum()) / (q / q.sum()))
    ratios[(counts[0] + counts[1]) == 0] = 0.0  # never seen: no evidence
    return ratios


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, weight_of: np.ndarray, bits: int, epochs: int = EPOCHS) -> np.ndarray:
    """Hinge-loss weights (the last is the bias) by coordinate descent in the dual; weight_of bounds each dual variable."""
    w = np.zeros((1 << bits) + 1)
    alpha = np.zeros(len(rows))
    sign = 2.0 * y - 1.0
    norm = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = sign[i] * (w[x] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), weight_of[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[x] += step * v
                w[-1] += step
                alpha[i] = new
    return w


class Model:
    """Scaled weights, and the curve that turns a margin into a probability."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float, bits: int):
        self.weights, self.bias, self.slope, self.offset, self.bits = weights.astype(np.float32), bias, slope, offset, bits

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum(dtype=np.float64)) / math.sqrt(len(x)) + self.bias if len(x) else self.bias

    def probability(self, x: np.ndarray) -> float:
        z = self.slope * self.margin(x) + self.offset
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def _fit(rows: list[np.ndarray], y: np.ndarray, bits: int) -> tuple[np.ndarray, float]:
    ratios = log_count_ratios(rows, y, bits)
    values = [ratios[x] / math.sqrt(max(1, len(x))) for x in rows]
    share = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())]) / len(y)
    w = dual_coordinate_descent(rows, values, y, COST * 0.5 / share[y.astype(int)], bits)
    return w[:-1] * ratios, float(w[-1])


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through smoothed labels, by Newton steps."""
    good, bad = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margins * margins).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-6), float(b)


def train(rows: list[np.ndarray], labels: list[int], bits: int = BITS) -> Model:
    """A model of indicators and their labels (0 or 1); the same rows in the same order give the same model."""
    y = np.array(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(1 << bits), 0.0, 1.0, math.log(p / (1 - p)), bits)
    margins = np.zeros(len(rows))
    part = np.arange(len(rows)) % 3
    for k in range(3):
        ins, outs = np.flatnonzero(part != k), np.flatnonzero(part == k)
        w, bias = _fit([rows[i] for i in ins], y[ins], bits)
        own = Model(w, bias, 1.0, 0.0, bits)
        margins[outs] = [own.margin(rows[i]) for i in outs]
    w, bias = _fit(rows, y, bits)
    return Model(w, bias, *_curve(margins, y), bits)


def fit(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE, label_col: str = "quality") -> Model:
    """Fit on at most max_sample labelled rows outside fold 0, those whose id has the smallest hash."""
    own = labels.where((fold(F.col("doc_id")) != 0) & F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
    own = own.groupBy("doc_id").agg(F.min(label_col).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    # at most max_sample ids and labels: a bound that does not depend on the data
    texts = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    ship(docs.sparkSession)

    @lean
    def columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "x": [indicators(t, words).astype("<i4").tobytes() for t in batch["text"]]})

    found = texts.select(F.col("doc_id").cast("long"), F.col("y").cast("int"), "text").mapInPandas(columns, "doc_id long, y int, x binary").collect()
    found.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["doc_id"]))
    model = train([np.frombuffer(r["x"], dtype="<i4") for r in found], [int(r["y"] == 1) for r in found])
    del found
    give_back()
    return model


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    ship(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.slope, model.offset, model.bits))

    @F.pandas_udf("double")
    @lean
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, words = Model(*shared.value), Words()
        for texts in batches:
            yield pd.Series([own.probability(indicators(t, words, own.bits)) for t in texts], index=texts.index, dtype="float64")

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels)
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score_column(docs.sparkSession, model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their columns."""
    model = fit(docs, labels)
    row = docs.select(F.struct(*docs.columns).alias("row"), score_column(docs.sparkSession, model, F.col("text")).alias("score"))
    return row.where(F.col("score") >= CUT).select("row.*")
