"""Which book a name means: the corpus's own aliases, then names in its documents, then built-in ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import normalize_column


def cascade(config: DataFrame, document: DataFrame, builtin: DataFrame) -> DataFrame:
    """corpus_id, alias_key, book_ord, source: the first source that has a key decides. Inputs have corpus_id, alias_key, book_ord."""
    ranked = None
    for priority, (source, df) in enumerate((("config", config), ("document", document), ("built-in", builtin))):
        own = df.select("corpus_id", "alias_key", "book_ord", F.lit(source).alias("source"), F.lit(priority).alias("priority"))
        ranked = own if ranked is None else ranked.unionByName(own)
    best = F.min_by(F.struct("book_ord", "source"), F.struct("priority", "book_ord"))
    return ranked.groupBy("corpus_id", "alias_key").agg(best.alias("b")).select("corpus_id", "alias_key", "b.book_ord", "b.source")


def resolve(names: DataFrame, aliases: DataFrame, present: DataFrame) -> DataFrame:
    """The book of each name (corpus_id, name), null if unknown or if the corpus lacks the book."""
    known = aliases.join(present.select("corpus_id", "book_ord").distinct(), ["corpus_id", "book_ord"], "left_semi")
    return names.withColumn("alias_key", normalize_column(F.col("name"))).join(known.select("corpus_id", "alias_key", "book_ord"), ["corpus_id", "alias_key"], "left").drop("alias_key")


def permutations(groups: list[DataFrame]) -> DataFrame:
    """All concatenations of one string of each group; groups are short lists of a configuration."""
    out = groups[0].select(F.col("value").alias("alias"))
    for g in groups[1:]:
        # lists of a few names each, from a configuration file
        out = out.join(F.broadcast(g), F.lit(True)).select(F.concat("alias", "value").alias("alias"))
    return out


def changed_words(old: DataFrame, new: DataFrame) -> DataFrame:
    """The stop words that only one of two lists has: what calls for a new index."""
    return old.select("word").exceptAll(new.select("word")).union(new.select("word").exceptAll(old.select("word"))).distinct()
