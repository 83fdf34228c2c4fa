"""Passages: the nodes of a reference, from its first verse with the headings before it, to the verse after its last."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.usj import nest

KEYS = ("corpus_id", "book_ord")


def heading_starts(n: DataFrame) -> DataFrame:
    """For each element at the root, where a passage that starts with it starts: the first of the titles right before it.

    Empty paragraphs between titles do not part them.
    """
    roots = n.where("depth = 1").select(*KEYS, F.col("path")[0].alias("root"), "is_title", "type", "child_count")
    empty = (F.col("type") == "para") & (F.col("child_count") == 0)
    title = F.col("is_title") & (F.col("child_count") == 1)
    before = Window.partitionBy(*KEYS).orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    runs = roots.withColumn("run", F.coalesce(F.max(F.when(~(empty | title), F.col("root"))).over(before), F.lit(-1))).withColumn("title_at", F.when(title, F.col("root")))
    within = Window.partitionBy(*KEYS, "run").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select(*KEYS, "root", F.coalesce(F.min("title_at").over(within), F.col("root")).alias("start_root"))


def verse_places(n: DataFrame) -> DataFrame:
    """Verse marks that are children of paragraphs at the root, with the place where a passage from them starts."""
    marks = n.where("type = 'verse' and depth = 2").select(*KEYS, "chapter", F.col("path")[0].alias("root"), F.col("path")[1].alias("inner"), "number_first", "number_last")
    with_start = marks.join(heading_starts(n), [*KEYS, "root"])
    start = F.when(F.col("inner") == 0, F.struct(F.col("start_root").alias("root"), F.lit(0).alias("inner"))).otherwise(F.struct("root", "inner"))
    return with_start.select(*KEYS, "chapter", F.struct("root", "inner").alias("place"), start.alias("start"), "number_first", "number_last")


def bounds(n: DataFrame, wanted: DataFrame) -> DataFrame:
    """start and end places of each wanted reference (req_id, corpus_id, book_ord, chapter, v_first, v_last); absent ones drop out.

    Places are (root, inner) and compare as such; a null end is the end of the document. The chapters of a book and the verse marks of a chapter
    are gathered once, as lists of one document, and a reference reads its places from them: two joins, however many places it asks for.
    """
    roots = n.where("type = 'chapter' and depth = 1").groupBy(*KEYS).agg(F.collect_list(F.struct(F.col("number_first").alias("number"), F.col("path")[0].alias("root"))).alias("chapters"))
    marks = verse_places(n).groupBy(*KEYS, "chapter").agg(F.array_sort(F.collect_list(F.struct("place", "start", "number_first", "number_last"))).alias("marks"))
    here = F.array_min(F.transform(F.filter("chapters", lambda c: c["number"] == F.col("chapter")), lambda c: c["root"]))
    base = wanted.join(roots, [*KEYS]).withColumn("chapter_root", here).where("chapter_root is not null").join(marks, [*KEYS, "chapter"], "left")

    # a number may be that of several chapters: the first one counts, up to the next chapter of any number
    until = F.array_min(F.filter(F.transform("chapters", lambda c: c["root"]), lambda r: r > F.col("chapter_root")))
    base = base.withColumn("chapter_until", until)
    base = base.withColumn("marks", F.filter("marks", lambda m: (m["place"]["root"] > F.col("chapter_root")) & F.coalesce(m["place"]["root"] < F.col("chapter_until"), F.lit(True))))

    def first(test: Callable[[Column], Column]) -> Column:
        """The first mark in the chapter that a test holds for."""
        return F.get(F.filter(F.coalesce("marks", F.array().cast(base.schema["marks"].dataType)), test), F.lit(0))

    holds = lambda m, v: (m["number_first"] <= v) & (v <= m["number_last"])
    one = base.withColumn("v1", first(lambda m: holds(m, F.col("v_first"))))
    one = one.withColumn("whole", (F.col("v_first") == 1) | F.coalesce(F.col("v1.number_first") == 1, F.lit(False))).where("whole or v1 is not null")
    top = F.struct(F.col("chapter_root").alias("root"), F.lit(0).alias("inner"))
    two = one.withColumn("from", F.when(F.col("whole"), top).otherwise(F.col("v1.start")))
    two = two.withColumn("e1", first(lambda m: holds(m, F.col("v_last") + 1) & (m["place"] >= F.col("from"))))
    # a bridge that holds the last verse and the one after it belongs to the passage: it ends at the verse after the bridge
    three = two.withColumn("e2", first(lambda m: holds(m, F.col("e1.number_last") + 1) & (m["place"] > F.col("e1.place")))["start"])
    verse_end = F.when(F.col("e1.number_first") == F.col("v_last") + 1, F.col("e1.start")).otherwise(F.col("e2"))
    later = F.array_min(F.filter(F.transform("chapters", lambda c: c["root"]), lambda r: r > F.col("from.root")))
    out = three.withColumns({"verse_end": verse_end, "next_root": later})
    chapter_end = F.when(F.col("next_root").isNotNull(), F.struct(F.col("next_root").alias("root"), F.lit(0).alias("inner")))
    return out.select("req_id", *KEYS, "chapter", "v_first", "v_last", "whole", F.col("from").alias("start_at"), F.coalesce("verse_end", chapter_end).alias("end_at"))


def passage_nodes(n: DataFrame, wanted: DataFrame) -> DataFrame:
    """The node rows of each wanted reference in page order. References are few and go to all tasks by their own size check (AQE)."""
    b = bounds(n, wanted).withColumnsRenamed({"chapter": "want_chapter", "v_first": "want_first", "v_last": "want_last"})
    rows = n.join(b, [*KEYS]).where("depth > 0")
    root, inner = F.col("path")[0], F.get("path", F.lit(1))
    in_para = (F.col("root_type") == "para") & inner.isNotNull()
    roots = n.where("depth = 1").select(*KEYS, F.col("path")[0].alias("own_root"), F.col("type").alias("root_type"))
    rows = rows.withColumn("own_root", root).join(roots, [*KEYS, "own_root"]).drop("own_root")
    after = (root > F.col("start_at.root")) | ((root == F.col("start_at.root")) & (~in_para | (inner >= F.col("start_at.inner"))))
    inside = F.col("end_at").isNull() | (root < F.col("end_at.root")) | ((root == F.col("end_at.root")) & (F.col("end_at.inner") > 0) & (~in_para | (inner < F.col("end_at.inner"))))
    sliced = rows.where(after & inside)
    first_chapter = n.where("type = 'chapter' and depth = 1").groupBy(*KEYS).agg(F.min("seq").alias("first_chapter"))
    text = n.where("type = 'text' and depth = 2").select(*KEYS, (F.col("seq") - 1).alias("l_seq"))
    labels = n.where("type = 'para' and marker = 'cl' and depth = 1 and child_count = 1").join(first_chapter, [*KEYS]).where("seq < first_chapter")
    labels = labels.join(text, [*KEYS]).where("l_seq = seq").groupBy(*KEYS).agg(F.min("seq").alias("label_seq"))
    wholes = b.where("whole").join(labels, [*KEYS])
    label_rows = n.join(wholes, [*KEYS]).where("seq >= label_seq and seq <= label_seq + 1").drop("label_seq")
    columns = ["req_id", *n.columns, "want_chapter", "want_first", "want_last", "start_at"]
    return sliced.select(*columns).unionByName(label_rows.select(*columns))


def passages(n: DataFrame, wanted: DataFrame, annotate: Callable[[list, tuple[int, int, int, int]], list] | None = None) -> DataFrame:
    """(req_id, content): the passage of each wanted reference as JSON; annotate may add notes to it."""
    import json

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.sort_values("seq")
        records = r.astype(object).where(r.notna(), None).to_dict("records")
        for x in records:
            x["path"] = [int(i) for i in x["path"]]
        content = nest(records)
        if annotate:
            one = records[0]
            content = annotate(content, (int(one["book_ord"]), int(one["want_chapter"]), int(one["want_first"]), int(one["want_last"])))
        return pd.DataFrame({"req_id": [records[0]["req_id"]], "content": pd.Series([json.dumps(content, ensure_ascii=False)], dtype=object)})

    # a group is one passage that a person asked for
    return passage_nodes(n, wanted).withColumn("req_id", F.col("req_id").cast("long")).groupBy("req_id").applyInPandas(build, "req_id long, content string")


def rebase(place: Column, start: Column) -> Column:
    """A place within the passage that starts at `start`: its root counts from the start, and in the first paragraph its inner index too."""
    root = place["path"][0] - start["root"]
    inner = F.when(place["path"][0] == start["root"], F.get(place["path"], F.lit(1)) - start["inner"]).otherwise(F.get(place["path"], F.lit(1)))
    rest = F.slice(place["path"], 3, F.greatest(F.size(place["path"]) - 2, F.lit(0)))
    return F.struct(F.concat(F.array(root, inner), rest).alias("path"), place["ch"].alias("ch"))
