"""Shards by jump consistent hashing.

A stable 64-bit key and the number of shards decide the shard; with one more shard a row stays or moves into the new
one, so about 1/(n+1) of the rows move. Shards are worked out once and stored with a number for each row, a few dozen bytes a row. The slot of a row within its
shard comes from two levels, so that no task sorts a whole shard: rows are ranked within (shard, lane) and lanes start at the sum of the counts before
them. Lanes follow the number of rows (LANE_ROWS each), and a row's number decides its lane, so that lanes are even whatever
keys and texts repeat.

Defined results: a null key counts as key -1. Keys are doc_ids, so repeated ids share a shard; a row's shards depend on its key alone, its slot is a number
within one result. A null text has no bytes; texts of any length are only measured. Rows that repeat have a slot each. An empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, store

SHARDS, LANE_ROWS, ROW_BYTES = 40, 50_000, 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump consistent hash of 64-bit keys, all at once."""
    key = keys.astype(np.uint64)
    at = np.full(len(key), -1, dtype=np.int64)
    jump = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = jump[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            # a jump beyond the shards ends; clipped so that it fits an integer
            jump[live] = np.minimum((at[live] + 1).astype(np.float64) * step, float(shards)).astype(np.int64)
            live = live[jump[live] < shards]
    return at


def jump_column(key, shards: int):
    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.fillna(-1).to_numpy(dtype=np.int64), shards).astype(np.int32))

    return shard(key)


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("number"))
    key = F.coalesce("doc_id", F.lit(-1))
    rows = store(slim.withColumns({"shard": jump_column(key, shards), "grown_shard": jump_column(key, shards + 1)}))
    lanes = 1 + rows.count() // (shards * LANE_ROWS)
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("number"), F.lit(lanes)).cast("int"))
    at = rows.groupBy("shard", "lane").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "lane").orderBy("number")
    ranked = rows.withColumn("within", F.row_number().over(within) - 1)
    # a row for each LANE_ROWS rows; the join picks its way by their size
    return ranked.join(starts, ["shard", "lane"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("within")).alias("slot"), "grown_shard")
