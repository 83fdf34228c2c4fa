"""Benchmark decontamination by pigeonhole edit matching.

An item of n normalised characters may differ from a passage by e = floor(rate * n) edits. Cut into e + 1 pieces, one piece at
least is untouched, so every passage within the budget holds an exact piece at about its place. One automaton
finds the pieces of all items in a text; each hit names an item and a diagonal, and Myers' bit-parallel distance over the
neighbourhood of that diagonal decides. Texts are not shuffled. The items go to the tasks in blocks of at most BLOCK_CHARS characters (and one
item), one block a pass: with more than one block, a pass ends in a stored table and its broadcast is freed before the next.

An item of fewer than LEAST_WORDS words ("Yes", "The first one") stands in ordinary text by chance, so it is found only where it is the whole text.

Normalised: lower case, every run of characters other than letters and digits one blank, a blank at both ends.
Defined results: null or empty items (after that) match nothing; repeated items match each, and an item with a null id is reported with that id;
null and empty texts hold nothing. Whole texts of any length are searched. Of an item's passages in a text the closest, then the first,
is reported. Rows that repeat are searched each; an empty table of documents gives no rows, an empty table of items finds nothing. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship, store

RATE, LEAST_WORDS = 0.06, 8
#: Characters of items in one block; each block is one broadcast.
BLOCK_CHARS = 1_000_000
GAP = re.compile(r"[\W_]+")
HIT = "doc_id long, item_id long, distance int, start long, end long"


def normalise(text: str) -> str:
    return f" {GAP.sub(' ', text.lower()).strip()} "


def pieces(n: int, errors: int) -> list[tuple[int, int]]:
    """(start, end) of errors + 1 nearly equal pieces of n characters."""
    edges = [n * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(edges, edges[1:], strict=False))


def myers(pattern_bits: dict[str, int], n: int, text: str) -> tuple[int, int]:
    """(least distance of the pattern to any substring of text, end of the first such substring)."""
    mask, high = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = mask, 0, n
    best, end = n, 0
    for at, c in enumerate(text, 1):
        eq = pattern_bits.get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) & mask) ^ plus) | x
        up, down = minus | (mask & ~(d | plus)), plus & d
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        # the first row is free: a passage may start anywhere
        up, down = up << 1, down << 1
        plus = (down | (mask & ~(d | up))) & mask
        minus = up & d & mask
        if score < best:
            best, end = score, at
    return best, end


def bits_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """The passages of a block of items in texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE, least_words: int = LEAST_WORDS):
        import ahocorasick

        known = [(i, p) for i, t in items if len(p := normalise(t)) > 2]
        self.items = [(i, p, int(len(p) * rate)) for i, p in known if len(p.split()) >= least_words]
        self.short: dict[str, list[int | None]] = {}
        for i, p in known:
            if len(p.split()) < least_words:
                self.short.setdefault(p, []).append(i)
        self.bits: dict[int, dict[str, int]] = {}
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (_, p, errors) in enumerate(self.items):
            for s, e in pieces(len(p), errors):
                at.setdefault(p[s:e], []).append((k, e))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, where)
        if at:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[dict]:
        if not text:
            return []
        t = normalise(text)
        whole = [{"item_id": i, "distance": 0, "start": 0, "end": len(text)} for i in self.short.get(t, [])]
        if not self.items:
            return whole
        found: dict[int, tuple[int, int, int]] = {}
        done: dict[int, int] = {}
        for last, where in self.automaton.iter(t):
            for k, e in where:
                item, p, errors = self.items[k]
                first = last + 1 - e  # where the passage starts, give or take the errors
                if k in found and found[k][0] == 0 or done.get(k) == first:
                    continue
                if t.startswith(p, max(0, first)):
                    found[k] = (0, max(0, first), max(0, first) + len(p))
                    continue
                if not errors:
                    continue
                done[k] = first
                low = max(0, first - errors)
                part = t[low : first + len(p) + errors]
                distance, end = myers(self.bits.setdefault(k, bits_of(p)), len(p), part)
                if distance <= errors and (k not in found or distance < found[k][0]):
                    # the start comes from matching the reversed passage
                    back = part[:end][::-1]
                    _, length = myers(bits_of(p[::-1]), len(p), back)
                    found[k] = (distance, low + end - length, low + end)
        if not found:
            return whole
        places = original_places(text)
        return whole + [{"item_id": self.items[k][0], "distance": d, "start": places(s, True), "end": places(e, False)} for k, (d, s, e) in sorted(found.items())]


def original_places(text: str):
    """A function from a place in the normalised text to one in the text."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case
        where = [i for i, c in enumerate(text) for _ in c.lower()]
    else:
        where = range(len(text))
    place, started = [0], False
    for m in re.finditer(r"[\W_]+|[^\W_]+", low):
        if re.match(r"[\W_]", m[0]):
            if started:
                place.append(m.start())
        else:
            started = True
            place += range(m.start(), m.end())

    def at(n: int, start: bool) -> int:
        n = min(max(n + start, 1), len(place)) if start else max(1, min(n, len(place)))
        if start:
            return where[place[n]] if n < len(place) else len(text)
        last = place[n - 1]
        if re.match(r"[\W_]", low[last : last + 1] or " "):
            return where[last] if last < len(where) else len(text)
        return where[last] + 1

    return at


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size, one after the other."""
    block, held = [], 0
    for r in benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        if block and held + len(r[1]) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((r[0], r[1]))
        held += len(r[1])
    if block:
        yield block


def passes(rows: DataFrame, benchmark: DataFrame, step: Callable[[DataFrame, Broadcast], DataFrame], chain: bool, item_cols: tuple[str, str]) -> list[DataFrame]:
    """step(rows, block) for each block of items; with chain, on what the step before left.

    One block, the usual case, stays a plan. With more, every result is stored, so that one block is held at a time.
    """
    spark = benchmark.sparkSession
    ship(spark)
    out: list[DataFrame] = []
    waiting: Broadcast | None = None
    for block in item_blocks(benchmark, *item_cols):
        if waiting is not None:
            out[-1] = store(out[-1])
            waiting.destroy()
        waiting = spark.sparkContext.broadcast(block)
        out.append(step(out[-1] if chain and out else rows, waiting))
    if len(out) > 1:
        out[-1] = store(out[-1])
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_cols: tuple[str, str] = ("item_id", "text")) -> DataFrame:
    """doc_id, item_id, distance, start, end of every passage of a benchmark item in a document."""

    def step(rows: DataFrame, block: Broadcast) -> DataFrame:
        @lean
        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(block.value, rate)
            for batch in batches:
                found = [(i, *m.values()) for i, t in zip(batch["doc_id"].astype("Int64").astype(object), batch["text"], strict=True) for m in matcher.matches(t)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "start", "end"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        return rows.mapInPandas(find, HIT)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = passes(rows, benchmark, step, False, item_cols) or [docs.sparkSession.createDataFrame([], HIT)]
    return functools.reduce(DataFrame.union, found)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", item_cols: tuple[str, str] = ("item_id", "text")) -> DataFrame:
    """The rows of docs whose text holds no item. Its columns stay as they are."""

    def step(rows: DataFrame, block: Broadcast) -> DataFrame:
        @F.pandas_udf("boolean")
        @lean
        def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = Matcher(block.value, rate)
            for texts in batches:
                yield pd.Series([bool(matcher.matches(t)) for t in texts], index=texts.index, dtype=bool)

        return rows.select("row", holds(F.col("row").getField(text_col)).alias("holds")).where(~F.col("holds")).select("row")

    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return ([rows] + passes(rows, benchmark, step, True, item_cols))[-1].select("row.*")
