"""Periodic runs: maximal stretches of words that repeat with a small period.

A run of period q and length n matches at lag q in n - q consecutive places, so a lag with fewer matches than that in the whole text has no run. Matches are
counted for all lags at once, by words: a frequent word (heavy) by the autocorrelation of its places through FFTs, rounded to the whole numbers that it consists of; a rare one
(light) by the differences of its places. Lags with enough matches are scanned for islands, from anchors: a run of four periods holds four equal words at neighbouring
multiples of q, which one pass over n / q places finds; an anchor inside a known run of a smaller period is none, as the island around it would have that period as well. Islands grow from
their anchors in doubling steps, so that a scan costs what it finds.

Documents are worked on a batch at a time, with the light words of a whole batch counted together; nothing is shuffled.

Defined results: a null or empty text, or one of blanks, has no words, hence no runs, and nothing collapses: its joined words are the empty text. A text of any length is read whole. Rows that repeat have
a result each; ties of the best run go to the smaller start, then the smaller period. With a null id nothing is planted by plant(). An empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship

#: A run is so many words long at least, and so many periods.
LEAST_WORDS, PERIODS = 6, 4
#: A word is heavy from so many occurrences on, and if the pairs of its places are more than this times the words of its text.
HEAVY, PAIR_COST = 64, 12
#: Words that are counted together.
BATCH_WORDS = 400_000
Run = tuple[int, int, int]


def matches_for(q: int) -> int:
    """Consecutive matches at lag q that a run needs."""
    return max(LEAST_WORDS, PERIODS * q) - q


# Counting lags --------------------------------------------------------------------------------------------------------


def heavy_counts(codes: np.ndarray, heavy: np.ndarray, top: int) -> np.ndarray:
    """Matches of the heavy words at lags 0 to top: the sum of their spectra's squares, transformed back."""
    n = len(codes)
    size = 1 << int(n + top).bit_length()
    power = np.zeros(size // 2 + 1)
    for w in heavy.tolist():
        f = np.fft.rfft(codes == w, size)
        power += f.real**2 + f.imag**2
    return np.rint(np.fft.irfft(power, size)[: top + 1]).astype(np.int64)


def lag_counts(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text of word codes the matches at lags 0 to a quarter of its length (0 counts as none)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    tops = sizes // PERIODS
    starts = np.concatenate(([0], np.cumsum(tops + 1)))
    total = np.zeros(int(starts[-1]), dtype=np.int64)
    if not sizes.sum():
        return [total[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    text_of = np.repeat(np.arange(len(texts)), sizes)
    place = np.concatenate([np.arange(n) for n in sizes])
    widths = np.array([int(t.max()) + 1 if len(t) else 0 for t in texts])
    word = np.concatenate(texts) + np.repeat(np.concatenate(([0], np.cumsum(widths)[:-1])), sizes)
    often = np.bincount(word)
    n_of = np.zeros(len(often), dtype=np.int64)
    n_of[word] = sizes[text_of]
    heavy = (often >= HEAVY) & (often.astype(np.float64) ** 2 > PAIR_COST * n_of * np.log2(n_of + 2))
    order = np.argsort(word, kind="stable")
    order = order[(often[word[order]] > 1) & ~heavy[word[order]]]
    # differences of the k-th next place of the same word; a pair too far apart is so for all larger k
    p, w, t = place[order], word[order], text_of[order]
    top_of, base = tops[t], starts[t]
    alive, k = np.arange(len(p)), 1
    while len(alive):
        alive = alive[: np.searchsorted(alive, len(p) - k)]
        alive = alive[w[alive] == w[alive + k]]
        d = p[alive + k] - p[alive]
        near = d <= top_of[alive]
        alive, d = alive[near], d[near]
        total += np.bincount(base[alive] + d, minlength=len(total))
        k += 1
    out = [total[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    if heavy.any():
        offsets = np.concatenate(([0], np.cumsum(widths)))
        for i in np.unique(np.searchsorted(offsets, np.flatnonzero(heavy), side="right") - 1):
            own = np.flatnonzero(heavy[offsets[i] : offsets[i + 1]])
            counts = heavy_counts(texts[i], own, int(tops[i]))
            counts[0] = 0
            out[i] = out[i] + counts
    return out


# Islands --------------------------------------------------------------------------------------------------------------


def _same(codes: np.ndarray, q: int, at: int, step: int) -> int:
    """How many places from `at` on in a direction match at lag q, by doubling windows."""
    n, width, seen = len(codes) - q, 64, 0
    while True:
        a = at + step * seen
        if step > 0:
            b = min(n, a + width)
            part = codes[a:b] != codes[a + q : b + q]
        else:
            b = max(-1, a - width)
            part = (codes[b + 1 : a + 1] != codes[b + 1 + q : a + 1 + q])[::-1]
        if not len(part):
            return seen
        first = int(part.argmax())
        if part[first]:
            return seen + first
        seen += len(part)
        width *= 2


def has_smaller(codes: np.ndarray, start: int, q: int) -> bool:
    """Does a stretch of period q, from start on, have a smaller period? Then one that divides q, by a prime."""
    rest, prime = q, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            p = q // prime
            if (codes[start : start + q] == codes[start + p : start + p + q]).all():
                return True
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return False


def runs(codes: np.ndarray, counts: np.ndarray) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    n = len(codes)
    lags = np.arange(len(counts))
    needed = np.maximum(LEAST_WORDS, PERIODS * lags) - lags
    out: list[Run] = []
    #: Of the runs so far the farthest end of those that cover a place.
    cover = np.zeros(n, dtype=np.int64)
    for q in np.flatnonzero((counts >= needed) & (lags > 0)).tolist():
        places = codes[::q]
        same = places[1:] == places[:-1]
        least = PERIODS - 1
        if len(same) < least:
            continue
        anchored = same[: len(same) - least + 1].copy()
        for k in range(1, least):
            anchored &= same[k : len(same) - least + 1 + k]
        at = np.flatnonzero(anchored) * q
        at = at[cover[at] <= at + least * q]  # the island has the words up to there, two periods and more
        done = 0
        for s in at.tolist():
            if s < done:
                continue
            right = _same(codes, q, s, 1)
            left = _same(codes, q, s - 1, -1) if s else 0
            done = s + right
            start, matches = s - left, left + right
            if matches < matches_for(q) or has_smaller(codes, start, q):
                continue
            out.append((start, matches + q, q))
            cover[start : start + matches + q] = np.maximum(cover[start : start + matches + q], start + matches + q)
    return sorted(out, key=lambda r: (r[0], r[2]))


def best(found: list[Run]) -> Run | None:
    """The run with the greatest length / period, exactly; ties by smaller start, then period."""
    top = None
    for r in found:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


def collapse(n: int, found: list[Run]) -> np.ndarray:
    """Which of n words stay: all but those of a run after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:-1] == 0


# Documents ------------------------------------------------------------------------------------------------------------


def plant(doc: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by the checksum of their id, with a period put in from some word on."""
    n = len(words)
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def coded(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def many_runs(texts: list[np.ndarray]) -> list[list[Run]]:
    """The runs of each text of word codes."""
    return [runs(t, c) for t, c in zip(texts, lag_counts(texts), strict=True)]


OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[int | None, list[bytes]], list[bytes]] | None = None, with_runs: bool = False, with_text: bool = False) -> DataFrame:
    """OUT of every document, with its runs (start, length, period) and its collapsed text where asked for. change: what is done with the words first."""
    ship(docs.sparkSession)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = pa.schema(
        [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), *[("runs", run_type)] * with_runs, *[("collapsed", pa.string())] * with_text]
    )

    def results(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        rows = []
        for doc, words, found in zip(ids, texts, many_runs([coded(w) for w in texts]), strict=True):
            top = best(found)
            told = b"".join(b"%d,%d,%d\n" % r for r in found)
            kept = b" ".join([w for w, k in zip(words, collapse(len(words), found).tolist(), strict=True) if k] if found else words)
            row = [doc, len(found), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None, hashlib.sha256(told).hexdigest(), hashlib.sha256(kept).hexdigest()]
            if with_runs:
                row.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            if with_text:
                row.append(kept.decode("utf-8", "replace"))
            rows.append(row)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    @lean
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()  # of bytes: parted at [\x20\x09-\x0D]
                words = change(doc, words) if change else words
                ids.append(doc)
                texts.append(words)
                held += len(words) + 1
                if held >= BATCH_WORDS:
                    yield results(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield results(ids, texts)

    columns = OUT + ", runs array<struct<start: bigint, length: bigint, period: bigint>>" * with_runs + ", collapsed string" * with_text
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(stage, columns)
