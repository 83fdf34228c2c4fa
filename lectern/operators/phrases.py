"""Phrases in stretches of words, longest first, as joins of postings; the same as PhraseBook.told, for any number of stretches and phrases.

Words that are in no phrase part a stretch into islands of neighbouring words (a window by position); from each word of an island, the word sequences that are the beginning of a phrase
are found by a join, and a fold over what was found goes from run to run: a run is the longest beginning from its first word, and the next one starts with the word
that ended it. What a run tells depends on the run alone and on whether a word follows in the stretch, so it is worked out once for each beginning: the run, if it is a phrase; else the
longest rest of it that is a beginning, if that one is a phrase and a word follows.

Everything runs in the JVM. Stretches shuffle once, their words in phrases only; a stretch (a sentence, a verse, a text) is in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import AXES, holding

#: Lemmas hold no blanks.
GAP = " "


def beginnings(phrases: DataFrame) -> DataFrame:
    """Of phrases (phrase: array of lemmas) all beginnings: run, size, and how many of its last words it tells if a word follows (mid), or none does (end)."""
    whole = phrases.where(F.size("phrase") > 0).select("phrase").distinct()
    parts = whole.select("phrase", F.explode(F.sequence(F.lit(1), F.size("phrase"))).alias("size"))
    runs = parts.groupBy(F.slice("phrase", 1, F.col("size")).alias("words"), "size").agg(F.max(F.col("size") == F.size("phrase")).alias("is_phrase"))
    rests = runs.where("size > 1 and not is_phrase").select("words", F.explode(F.sequence(F.lit(2), F.col("size"))).alias("at"))
    rests = rests.select("words", F.expr("slice(words, at, size(words))").alias("rest"))
    known = runs.select(F.col("words").alias("rest"), F.col("size").alias("rest_size"), F.col("is_phrase").alias("rest_is_phrase"))
    longest = rests.join(known, "rest").groupBy("words").agg(F.max(F.struct("rest_size", "rest_is_phrase")).alias("longest"))
    told = F.when(F.col("is_phrase"), F.col("size")).otherwise(0)
    mid = F.when(F.col("is_phrase"), F.col("size")).when(F.col("longest.rest_is_phrase"), F.col("longest.rest_size")).otherwise(0)
    return runs.join(longest, "words", "left").select(F.array_join("words", GAP).alias("run"), "size", mid.alias("mid"), told.alias("end"))


def told(postings: DataFrame, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, size, phrase of each phrase that is told.

    postings: keys (of a stretch), pos (its words are numbered without gaps), lemma, last_pos (of the stretch). phrases: phrase (array of lemmas).
    """
    runs = beginnings(phrases)
    words = phrases.select(F.explode("phrase").alias("lemma")).distinct()
    longest = phrases.agg(F.max(F.size("phrase"))).first()[0] or 0
    known = postings.select(*keys, "pos", "lemma", "last_pos").join(words, "lemma", "left_semi")
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    held = known.withColumn("island", island).groupBy(*keys, "island").agg(F.min("pos").alias("first"), F.max("last_pos").alias("last_pos"), F.array_sort(F.collect_list(F.struct("pos", "lemma"))).alias("held"))
    held = held.select(*keys, "first", "last_pos", F.transform("held", lambda x: x["lemma"]).alias("words"))
    at, size = F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("at"), F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("words") - F.col("at")))).alias("size")
    grams = held.select(*keys, "first", "last_pos", "words", at).select(*keys, "first", "last_pos", "at", size, "words")
    grams = grams.select(*keys, "first", "last_pos", "at", F.expr(f"array_join(slice(words, at + 1, size), '{GAP}')").alias("run"))
    found = grams.join(runs, "run").select(*keys, "first", "last_pos", F.struct("at", (-F.col("size")).alias("less"), "mid", "end", "run").alias("found"))
    each = found.groupBy(*keys, "first", "last_pos").agg(F.array_sort(F.collect_list("found")).alias("found"))
    empty = F.array().cast("array<struct<at: int, size: int, run: string>>")

    def go(state, x):
        stop = x["at"] - x["less"]  # where the run ends
        size = F.when(F.col("first") + stop > F.col("last_pos"), x["end"]).otherwise(x["mid"])
        tells = F.concat(state["out"], F.array(F.struct((stop - size).alias("at"), size.alias("size"), x["run"].alias("run"))))
        return F.when(x["at"] < state["next"], state).otherwise(F.struct(stop.alias("next"), F.when(size > 0, tells).otherwise(state["out"]).alias("out")))

    runs_of = F.aggregate("found", F.struct(F.lit(0).alias("next"), empty.alias("out")), go, lambda s: s["out"])
    out = each.select(*keys, "first", F.inline(runs_of))
    # a rest is the last words of its run
    return out.select(*keys, (F.col("first") + F.col("at")).alias("pos"), "size", F.expr(f"array_join(slice(split(run, '{GAP}'), -size, size), '{GAP}')").alias("phrase"))


def notes(found: DataFrame, rules: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """The first place, within `within` and by `order`, of each phrase and note: found (as told() gives them, with AXES) under rules (phrase text, low, high, priority, note).

    A phrase without a rule at its place hides the shorter ones in it, as it was told.
    """
    each = holding(found.select(*dict.fromkeys([*within, "phrase", *AXES, *order])), rules, ["phrase"])
    first = each.groupBy(*within, "phrase", "note").agg(F.min(F.struct(*order, *[c for c in AXES if c not in order and c not in within])).alias("at"))
    return first.select(*within, "phrase", "note", "at.*")
