"""Conjunctive term search over postings: probe, group, count, order, page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import lemmas

REF = ("book_ord", "chapter", "v_first", "v_last")
PAGE, LARGEST_PAGE = 50, 250


class SearchError(ValueError):
    status = 400


def check_page(start: int, count: int) -> None:
    if start < 0 or not 0 <= count <= LARGEST_PAGE:
        raise SearchError(f"start must not be negative, and count at most {LARGEST_PAGE}")


def query_frame(spark: SparkSession, term: str, languages: list[str] | None = None) -> DataFrame:
    """The words of a query, one row each; a word that repeats counts each time."""
    return spark.createDataFrame([(w,) for w in lemmas(term, languages)], "lemma string")


def probe(p: DataFrame, term: str, languages: list[str] | None = None) -> DataFrame:
    """The postings of a query's words, as a filter that reaches the scan: row groups of stored postings without any of them are not read (by their ranges and Bloom filters)."""
    return p.where(F.col("lemma").isin(lemmas(term, languages)))


def hits(p: DataFrame, query: DataFrame, mode: str = "occurrence") -> DataFrame:
    """References with their occurrences, in canonical order by `orderBy` of the caller.

    occurrence: as many occurrences of query words as there are query words that the index knows. all_terms: every known query
    word occurs. The query is the few words that a person typed, so it goes to all tasks; what the probe leaves of the postings is counted
    before it is shuffled by reference, once.
    """
    asked = query.groupBy("lemma").agg(F.count(F.lit(1)).alias("times"))
    found = p.join(F.broadcast(asked), "lemma").select("corpus_id", *REF, "lemma", "times")
    # a set of the query's words that occur: both counts combine in the tasks of the scan
    grouped = found.groupBy("corpus_id", *REF).agg(F.sum("times").alias("occurrences"), F.collect_set("lemma").alias("held"))
    grouped = grouped.withColumn("terms", F.size("held"))
    there = grouped.select(F.explode("held").alias("lemma")).distinct()
    known = asked.join(F.broadcast(there), "lemma", "left_semi").agg(F.sum("times").alias("n_all"), F.count(F.lit(1)).alias("n_terms"))
    # one row
    both = grouped.join(F.broadcast(known))
    return both.where(F.col("occurrences") == F.col("n_all") if mode == "occurrence" else F.col("terms") == F.col("n_terms")).select("corpus_id", *REF, "occurrences")


def highlights(p: DataFrame, query: DataFrame, chosen: DataFrame) -> DataFrame:
    """The places of the query words in the chosen references, in text order."""
    found = p.join(F.broadcast(query.distinct()), "lemma").join(chosen.select("corpus_id", *REF), ["corpus_id", *REF], "left_semi")
    place = F.struct("segment", "pos", "start", "end")
    return found.groupBy("corpus_id", *REF).agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("highlights"))


def page(h: DataFrame, start: int = 0, count: int = PAGE) -> DataFrame:
    """A page in canonical order. Content is joined to the page, not the page cut from the join."""
    check_page(start, count)
    return h.orderBy(*REF).offset(start).limit(count)
