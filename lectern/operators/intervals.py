"""Rules that hold from one reference to another: which rule holds at a place, the later one where several do.

A reference is four whole numbers (book, chapter, first and last verse), compared one after another. A rule's span falls into at most seven ranges of one number under equal
numbers before it, and a range into pieces: aligned stretches of a power of two, two of each length at most. A place lies in one piece of each length, so that rules and places
meet by equal keys, without a comparison of ranges. Of a piece only the rule of the highest priority can hold, so each key has one row on the rules' side, and a
place never meets more rows than there are lengths; lengths that no rule has are not asked for. Numbers beyond all that rules name are alike, which bounds the lengths. What is stored and has many rows
is never broadcast: its files hold a few bytes a row, by which Spark takes millions of rows for a small table. The adaptive join splits a key that many places have.

Defined results: a span whose low end is above its high end holds nowhere; a rule or place with a null number takes no part; numbers run from 0 to 2^31 - 1, and a
rule's beyond that are cut to them. Of rules of equal priority the greatest note wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

AXES = ("book_ord", "chapter", "v_first", "v_last")
BITS = 31
TOP = (1 << BITS) - 1
KEY = ("axis", "level", "head1", "head2", "head3", "piece")
#: Stored rows that may go to all tasks: some 300 bytes each in memory.
FEW = 50_000


def _heads(values: list[Column], axis: int) -> list[Column]:
    """The numbers before an axis; -1 for those from it on."""
    return [(values[k] if k < axis else F.lit(-1)).cast("long").alias(f"head{k + 1}") for k in range(3)]


def _ranges(low: list[Column], high: list[Column], tops: list[int]) -> Column:
    """The ranges (axis, heads, a, b, bits) that a span is made of; empty ones are among them."""
    out = []
    for axis in range(4):
        same = F.lit(True)
        for k in range(axis):
            same = same & (low[k] == high[k])
        last = axis == 3
        row = lambda values, a, b, ok, axis=axis: F.struct(F.lit(axis).alias("axis"), *_heads(values, axis), F.when(ok, a).otherwise(1).cast("long").alias("a"), F.when(ok, b).otherwise(0).cast("long").alias("b"), F.lit(tops[axis].bit_length()).alias("bits"))
        # both ends have the same numbers before this one: what lies between them
        out.append(row(low, low[axis] if last else low[axis] + 1, high[axis] if last else high[axis] - 1, same))
        if axis:
            apart = ~same
            # the ends part before: from the low one upward, and up to the high one
            rises = low_below_high(low, high, axis)
            out.append(row(low, low[axis] if last else low[axis] + 1, F.lit(tops[axis]), apart & rises))
            out.append(row(high, F.lit(0), high[axis] if last else high[axis] - 1, apart & rises))
    return F.array(*out)


def low_below_high(low: list[Column], high: list[Column], axes: int) -> Column:
    """Are the first numbers of the low end before those of the high end?"""
    out = F.lit(False)
    for k in reversed(range(axes)):
        out = (low[k] < high[k]) | ((low[k] == high[k]) & out)
    return out


def _pieces(a: Column, b: Column, bits: Column) -> Column:
    """The aligned stretches (level, piece) of the range a to b: at each level what no longer one covers, one at either end at most."""

    def of_level(k: Column) -> Column:
        size = F.lit(1).cast("long") * F.element_at(F.array(*[F.lit(1 << j).cast("long") for j in range(BITS + 1)]), k + 1)
        first = F.ceil(a / size).cast("long")
        last = F.floor((b + 1) / size).cast("long") - 1
        ends = F.array(F.when(first % 2 == 1, first), F.when(last % 2 == 0, last))
        return F.transform(F.when(first <= last, F.array_compact(ends)).otherwise(F.array().cast("array<bigint>")), lambda p: F.struct(k.cast("int").alias("level"), p.alias("piece")))

    return F.flatten(F.transform(F.sequence(F.lit(0), bits), of_level))


def tops_of(rules: DataFrame) -> list[int]:
    """For each number a bound above all that rules name: one less than a power of two."""
    most = [F.max(F.greatest(F.col(f"low.{a}"), F.col(f"high.{b}"))) for a, b in zip(rules.schema["low"].dataType.names, rules.schema["high"].dataType.names, strict=True)]
    return [(1 << (min(max(m or 0, 0), TOP - 1) + 1).bit_length()) - 1 for m in rules.agg(*most).first()]


def lookup(rules: DataFrame, on: list[str], tops: list[int]) -> DataFrame:
    """Rules (on, low, high, priority, note) as one row a piece: on, KEY, best (priority, note)."""
    low, high = ([F.col(f"{end}.{f}").cast("long") for f in rules.schema[end].dataType.names] for end in ("low", "high"))
    known = F.lit(True)
    for c in (*low, *high):
        known = known & c.isNotNull()
    cut = lambda ends: [F.least(F.greatest(c, F.lit(0)), F.lit(top)) for c, top in zip(ends, tops, strict=True)]
    each = rules.where(known).select(*on, F.struct("priority", "note").alias("rule"), F.inline(_ranges(cut(low), cut(high), tops))).where("a <= b")
    pieces = each.select(*on, "rule", "axis", "head1", "head2", "head3", F.inline(_pieces(F.col("a"), F.col("b"), F.col("bits"))))
    return pieces.groupBy(*on, *KEY).agg(F.max("rule").alias("best"))


def _bounded(rows: DataFrame, n: int) -> DataFrame:
    """n stored rows, joined by a shuffle unless they are few."""
    return rows if n <= FEW else rows.hint("merge")


def holding(rows: DataFrame, rules: DataFrame, on: list[str]) -> DataFrame:
    """rows (on, AXES, and more) with priority and note of the rule that holds there; rows without a rule go.

    on: what a rule and a row must have in common, such as a lemma. Rows that share it with a rule are stored, as they are read twice; so are the pieces of the rules, whose levels are the
    only ones that places are asked at.
    """
    tops = tops_of(rules)
    values = [F.least(F.col(c).cast("long"), F.lit(top)) for c, top in zip(AXES, tops, strict=True)]
    pieces = stored(lookup(rules, on, tops))
    # at most 32 levels of four axes
    counts = {(r["axis"], r["level"]): r["n"] for r in pieces.groupBy("axis", "level").agg(F.count(F.lit(1)).alias("n")).collect()}
    levels = sorted(counts)
    keys = [F.struct(F.lit(axis).alias("axis"), F.lit(level).alias("level"), *_heads(values, axis), F.shiftright(values[axis], level).alias("piece")) for axis, level in levels or [(0, 0)]]
    some = stored(rows.join(stored(pieces.select(*on).distinct()), on, "left_semi"))
    places = some.select(*on, *AXES).distinct()
    met = places.select("*", F.inline(F.array(*keys))).join(_bounded(pieces, sum(counts.values())), [*on, *KEY])
    best = met.groupBy(*on, *AXES).agg(F.max("best").alias("best"))
    return _bounded(some, some.count()).join(best, [*on, *AXES]).withColumns({"priority": F.col("best.priority"), "note": F.col("best.note")}).drop("best")
