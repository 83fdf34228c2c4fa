"""The order of books, and the chapters before and after a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.catalog import Catalog, load


def book_order(spark: SparkSession, groups: list[list[int]] | None = None, catalog: Catalog | None = None) -> DataFrame:
    """group_id, pos, book_ord: neighbours share a group; books that no group names stand alone. Without groups, the canon."""
    catalog = catalog or load()
    every = [b.ord for b in catalog.books]
    groups = [every] if groups is None else groups
    named = {o for g in groups for o in g}
    groups = groups + [[o] for o in every if o not in named]
    return spark.createDataFrame([(g, i, o) for g, books in enumerate(groups) for i, o in enumerate(books)], "group_id int, pos int, book_ord int")


def neighbours(order: DataFrame) -> DataFrame:
    """The book before and after each book."""
    w = Window.partitionBy("group_id").orderBy("pos")
    return order.select("group_id", "pos", "book_ord", F.lag("book_ord").over(w).alias("predecessor"), F.lead("book_ord").over(w).alias("successor"))


def successors(order: DataFrame) -> DataFrame:
    """All books after each book of its group, in order."""
    w = Window.partitionBy("group_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    return order.select("book_ord", F.collect_list("book_ord").over(w).alias("successors"))


def flat_order(order: DataFrame) -> DataFrame:
    """The groups as lists, as they are written: a null between two."""
    return order.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("pos", "book_ord"))).alias("books")).select("group_id", F.transform("books", lambda b: b["book_ord"]).alias("books"))


def adjacent_chapters(chapters: DataFrame, wanted: DataFrame, order: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """previous and next existing chapter (book_ord, chapter) of each wanted (req_id, corpus_id, book_ord, chapter).

    Chapters beyond the catalog's count cannot be reached. A wanted chapter need not exist: the nearest ones around its place count. A book
    without chapters in the catalog has neither.

    Neighbours are worked out once for each place that exists or is asked for: a few thousand a corpus at most, as numbers
    outside a book count as the places before and after it. Requests meet them in a join; however many there are, no window holds them.
    """
    catalog = catalog or load()
    dim = catalog.frame(wanted.sparkSession).select(F.col("ord").alias("book_ord"), "chapter_count")
    dim = dim.join(order.select("book_ord", "group_id", "pos"), "book_ord")
    dim = F.broadcast(dim)  # 113 books
    last = F.greatest("chapter_count", F.lit(1))
    place = ["corpus_id", "book_ord", "chapter"]
    there = chapters.select("corpus_id", "book_ord", F.col("number").alias("chapter")).distinct().join(dim, "book_ord").where(F.col("chapter") <= last)
    asked = wanted.select(F.col("req_id").cast("long").alias("req_id"), *place).join(dim, "book_ord").where("chapter_count > 0").withColumn("chapter", F.least(F.greatest("chapter", F.lit(-1)), last + 1))
    marked = there.select("corpus_id", "group_id", "pos", "book_ord", "chapter", F.lit(True).alias("exists")).unionByName(asked.select("corpus_id", "group_id", "pos", "book_ord", "chapter", F.lit(False).alias("exists")))
    places = marked.groupBy("corpus_id", "group_id", "pos", "book_ord", "chapter").agg(F.max("exists").alias("exists"))
    own = F.when(F.col("exists"), F.struct("book_ord", "chapter"))
    line = Window.partitionBy("corpus_id", "group_id")
    before = line.orderBy("pos", "chapter").rowsBetween(Window.unboundedPreceding, -1)
    after = line.orderBy(F.desc("pos"), F.desc("chapter")).rowsBetween(Window.unboundedPreceding, -1)
    near = places.withColumns({"previous_chapter": F.last(own, ignorenulls=True).over(before), "next_chapter": F.last(own, ignorenulls=True).over(after)})
    return asked.select("req_id", *place).join(near.select(*place, "previous_chapter", "next_chapter"), place).select("req_id", "previous_chapter", "next_chapter")
