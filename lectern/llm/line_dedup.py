"""Corpus-wide line deduplication in DataFrame operations only.

Lines are exploded with their position, their normalised key is hashed to 128 bits, distinct documents are counted per
hash, and the positions of the lines over the threshold come back to their document, which is put together without them.
Texts move once (to meet their positions); the counting shuffles hashes only. A hot line is spread by the distinct count,
which first groups by (hash, document), and by the adaptive skew join, which splits its partition.

Defined results: a null text is one empty line. Documents are told apart by doc_id: rows that repeat a doc_id count once,
and all null ids count as one document, which is smaller than any other. Every row is returned, repeated ones too, and
other columns pass through, whatever their names. Of equal ids that hold a line last, each row keeps it. Texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, hash128

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, t1, t2 (which row of docs), pos, key of every line. Keys are made before lines are exploded, so that each is worked out once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    t1, t2 = hash128(text)
    return docs.select(F.col(id_col).alias("doc"), t1.alias("t1"), t2.alias("t2"), F.posexplode(F.transform(F.split(text, "\n"), line_key)).alias("pos", "key"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, t1, t2, pos) of every line to drop: its key has min_chars and min_docs documents, and a larger doc_id holds it."""
    long = _keys(docs, id_col, text_col).where(F.length("key") >= min_chars)
    h1, h2 = hash128(F.col("key"))
    long = long.select("doc", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2"))
    pairs = long.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    common = pairs.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    # another join key than the grouping key: both sides are then shuffled for the join, and the adaptive join can split a hot line
    turned = F.bitwise_not("h1").alias("turned")
    met = long.select("doc", "t1", "t2", "pos", turned, "h2").join(common.select(turned, "h2", "keeper"), ["turned", "h2"])
    return met.where(~F.col("doc").eqNullSafe(F.col("keeper"))).select("doc", "t1", "t2", "pos")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with their kept text as the text column, and one struct column `line_stats` (n_lines, n_dropped) at the end.

    A column of docs named line_stats is replaced.
    """
    gone = dropped_lines(docs, id_col, text_col, min_chars, min_docs)
    gone = gone.groupBy("doc", "t1", "t2").agg(F.collect_set("pos").alias("gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    t1, t2 = hash128(text)
    # the split stays below the join, so that it is done once a row and not once for each line that is kept
    others = [c for c in docs.columns if c not in (text_col, "line_stats")]
    left = docs.select(F.struct(*others).alias("row"), F.col(id_col).alias("l_doc"), t1.alias("l_t1"), t2.alias("l_t2"), F.split(text, "\n").alias("lines"))
    both = left.join(gone, F.col("l_doc").eqNullSafe(F.col("doc")) & (F.col("l_t1") == F.col("t1")) & (F.col("l_t2") == F.col("t2")), "left")
    n = F.size("lines")
    left_over = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(left_over, lambda i: F.get("lines", i)), "\n"))
    stats = F.struct(n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    out = both.select("row", kept.alias("kept"), stats.alias("stats"))
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c != "line_stats"], F.col("stats").alias("line_stats"))
