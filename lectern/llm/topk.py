"""Exact top-k by inner product over a vector-approximation file.

Vectors are integers (floor of 256 times each component). The approximation file holds, for each row, its id, a hash of its vector and the cell of every
component: its leading bits, one byte, in blocks with a cell width for each dimension. Queries, a stated set, are packed into blocks too.

First the file is scanned: every block of cells meets every block of queries, and the cells give a lower and an upper bound for each score. A row whose upper
bound is below the kth best lower bound is out, and so is one that k rows of the same vector and smaller ids stand before; what stays is (query, row, upper bound). Then exact vectors are read in the order of the bounds: for
the NEAR best of each query first, whose kth exact score rules out all but the few rows whose upper bound still reaches it; those
are read next, and the kth result is certain. Exact vectors travel for such candidates only, cells (an eighth of a long) for the scan.

Row blocks are copied once for each block of QUERIES_A_BLOCK queries, query blocks once for each of `lanes`: tasks are the products, and both
copies are of cells or of queries, not of exact rows. Nothing is joined or broadcast for it: queries are dealt to blocks by a hash, and cells list the numbers of the blocks.

Defined results: vectors that are null or hold null or non-finite components take no part; empty vectors have no component
and take no part. Only vectors of equal length are compared. A query's own row is every row with its vec_id; where rows repeat
a query's id, the smallest vector asks. Candidates that repeat an id count each. Null ids take no part. An empty table, and one without a query, give no rows;
other columns are not read, whatever their names. Components of 2**50 and more, and scores beyond a long, are outside the contract.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, ship, store

K, EVERY, SCALE = 5, 50, 256
#: Rows of a block of cells, queries of a block, queries that a task compares at a time.
ROWS_A_BLOCK, QUERIES_A_BLOCK, QUERIES_AT_ONCE, LANES = 1024, 8192, 1024, 24
#: Leading bits of a component in its cell, with its sign; exact vectors read in the first turn, over k.
CELL_BITS, NEAR = 8, 4


def integer_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array of long), of the rows that take part."""
    v = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def cells_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of some vectors (rows x dimensions, one byte) and the width of a cell in each dimension, as a shift."""
    top = np.maximum(vectors.max(axis=0), ~vectors.min(axis=0))
    shift = np.array([max(0, int(x).bit_length() - (CELL_BITS - 1)) for x in top], dtype=np.int64)
    return (vectors >> shift).astype(np.int8), shift


def bounds(queries: np.ndarray, cells: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of the lower edges of the cells (queries x rows), and what each query may gain or lose within them."""
    low = (cells.astype(np.int64) << shift).astype(np.float64)
    wide = ((np.int64(1) << shift) - 1).astype(np.float64)
    q = queries.astype(np.float64)
    # float sums of large integers may round; the slack keeps the bounds on the safe side
    slack = np.abs(q) @ (np.abs(low).max(axis=0, initial=0) + wide + 1) * 1e-12
    return q @ low.T, np.maximum(q, 0) @ wide + slack, np.minimum(q, 0) @ wide - slack


class Scan:
    """The candidates of a block of queries, as blocks of cells come by."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.best = np.full((len(ids), k), -np.inf)  # the best lower bounds
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def meet(self, ids: np.ndarray, hashes: np.ndarray, cells: np.ndarray, shift: np.ndarray) -> None:
        for at in range(0, len(self.ids), QUERIES_AT_ONCE):
            part = slice(at, at + QUERIES_AT_ONCE)
            edge, gain, loss = bounds(self.queries[part], cells, shift)
            edge[self.ids[part, None] == ids] = -np.inf
            lows = np.concatenate([self.best[part], edge + loss[:, None]], axis=1)
            self.best[part] = np.partition(lows, lows.shape[1] - self.k, axis=1)[:, -self.k :]
            upper = edge + gain[:, None]
            q, r = np.nonzero((upper >= self.best[part].min(axis=1)[:, None]) & (edge > -np.inf))
            self.found.append((q + at, ids[r], hashes[r], upper[q, r]))
            self.held += len(q)
        if self.held > 1_000_000:
            self.prune()

    def prune(self) -> None:
        """Drop what the best lower bounds rule out, and of rows with one vector all but the k of the least ids: the others lose the tie."""
        q, ids, hashes, upper = (np.concatenate(c) for c in zip(*self.found, strict=True))
        keep = upper >= self.best.min(axis=1)[q]
        q, ids, hashes, upper = q[keep], ids[keep], hashes[keep], upper[keep]
        order = np.lexsort((ids, hashes, q))
        q, ids, hashes, upper = q[order], ids[order], hashes[order], upper[order]
        fresh = np.concatenate(([True], (q[1:] != q[:-1]) | (hashes[1:] != hashes[:-1]))) if len(q) else np.zeros(0, dtype=bool)
        starts = np.maximum.accumulate(np.where(fresh, np.arange(len(q)), 0))
        keep = np.arange(len(q)) - starts < self.k
        self.found, self.held = [(q[keep], ids[keep], hashes[keep], upper[keep])], int(keep.sum())

    def result(self) -> Iterator[pd.DataFrame]:
        """Rows of candidates with their upper bounds, and the best lower bounds as rows without one."""
        if self.found:
            self.prune()
            q, ids, hashes, upper = self.found[0]
            for at in range(0, len(q), 100_000):
                s = slice(at, at + 100_000)
                yield pd.DataFrame({"query_id": self.ids[q[s]], "vec_id": ids[s], "h": hashes[s], "upper": upper[s], "lower": np.nan})
        q, j = np.nonzero(self.best > -np.inf)
        yield pd.DataFrame({"query_id": self.ids[q], "vec_id": np.zeros(len(q), dtype=np.int64), "h": np.zeros(len(q), dtype=np.int64), "upper": np.nan, "lower": self.best[q, j]})


def pack_blocks(size: int, approximate: bool):
    """Rows (vec_id, h, v) into rows (dim, ids, hashes, vectors, shift), size at most in each; vectors are cells or longs."""

    @lean
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(batch["vec_id"], batch["h"], batch["v"], strict=True):
                dim = len(row[2])
                held.setdefault(dim, []).append(row)
                if len(held[dim]) >= size:
                    yield block(held.pop(dim))
        for rows in held.values():
            yield block(rows)

    def block(rows: list[tuple]) -> pd.DataFrame:
        vectors = np.array([v for _, _, v in rows], dtype="<i8")
        cells, shift = cells_of(vectors) if approximate else (vectors, np.zeros(vectors.shape[1], dtype="<i8"))
        pair = [np.array([r[i] for r in rows], dtype="<i8").tobytes() for i in (0, 1)]
        return pd.DataFrame({"dim": [vectors.shape[1]], "ids": [pair[0]], "hashes": [pair[1]], "vectors": [cells.tobytes()], "shift": [shift.astype("<i1").tobytes()]})

    return pack


BLOCK = "dim int, ids binary, hashes binary, vectors binary, shift binary"


def scan_file(rows: DataFrame, asking: DataFrame, k: int, lanes: int) -> DataFrame:
    """(query_id, vec_id, h, upper, lower): candidates with an upper bound, and lower bounds that at least as many rows reach."""
    file = rows.mapInPandas(pack_blocks(ROWS_A_BLOCK, True), BLOCK).withColumn("lane", F.pmod(F.xxhash64("ids", "hashes"), F.lit(lanes)).cast("int"))
    blocks = -(-asking.count() // QUERIES_A_BLOCK)
    dealt = asking.select("vec_id", "h", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))).cast("int").alias("qb"))
    one = lambda key, rows: next(pack_blocks(len(rows), False)([rows])).assign(qb=key[0])
    # QUERIES_A_BLOCK rows a group, nearly
    q = dealt.groupBy("qb", "dim").applyInPandas(one, BLOCK + ", qb int").select("qb", "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    # a task is (block of queries, lane): its rows are the block itself, then the cells of the lane
    spread = q.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    nothing = {c: F.lit(None).cast("binary") for c in ("ids", "hashes", "vectors", "shift")}
    first = spread.select("qb", "lane", "dim", F.lit(0).alias("part"), "q_ids", "q_vectors", *[v.alias(c) for c, v in nothing.items()])
    met = file.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)) if blocks else F.array().cast("array<int>"))).select("qb", "lane", "dim", F.lit(1).alias("part"), F.lit(None).cast("binary").alias("q_ids"), F.lit(None).cast("binary").alias("q_vectors"), *nothing)
    tasks = first.unionByName(met).repartition("qb", "lane", "dim").sortWithinPartitions("qb", "lane", "dim", "part")

    @lean
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = now = None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.part == 0:
                    if now is not None:
                        yield from now.result()
                    at, now = (r.qb, r.lane, r.dim), Scan(np.frombuffer(r.q_ids, dtype="<i8"), np.frombuffer(r.q_vectors, dtype="<i8").reshape(-1, r.dim), k)
                elif (r.qb, r.lane, r.dim) == at:  # not cells of a length that no query of the block has
                    now.meet(np.frombuffer(r.ids, dtype="<i8"), np.frombuffer(r.hashes, dtype="<i8"), np.frombuffer(r.vectors, dtype=np.int8).reshape(-1, r.dim), np.frombuffer(r.shift, dtype="<i1").astype(np.int64))
        if now is not None:
            yield from now.result()

    return tasks.mapInPandas(search, "query_id long, vec_id long, h long, upper double, lower double")


def top_k(df: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", lanes: int = LANES) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query (vec_id divisible by `every`)."""
    ship(df.sparkSession)
    rows = integer_vectors(df, id_col, vec_col).withColumn("h", F.xxhash64("v"))
    asking = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("h", F.xxhash64("v"))
    found = store(scan_file(rows, asking, k, lanes))
    by_query = Window.partitionBy("query_id")
    # the kth best lower bound over all lanes: k rows a query and lane
    lows = found.where("upper is null").withColumn("r", F.row_number().over(by_query.orderBy(F.desc("lower")))).where(F.col("r") == k).select("query_id", F.col("lower").alias("least"))
    near = found.where("upper is not null").drop("lower").join(lows, "query_id", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).drop("least")
    near = store(near.withColumn("turn", F.row_number().over(by_query.orderBy(F.desc("upper"), "vec_id", "h"))))
    one = store(exact(near.where(F.col("turn") <= NEAR * k), rows, asking))
    # rows that can still reach the kth exact score
    kth = one.withColumn("r", F.row_number().over(by_query.orderBy(F.desc("score")))).where(F.col("r") == k).select("query_id", F.col("score").alias("kth"))
    more = near.where(F.col("turn") > NEAR * k).join(kth, "query_id").where(F.col("upper") >= F.col("kth")).drop("kth")
    scores = one.unionByName(exact(more, rows, asking))
    rank = F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(pairs: DataFrame, rows: DataFrame, asking: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of candidates (query_id, vec_id, h): their exact vectors are fetched by id and hash."""
    wanted = pairs.select("vec_id", "h").distinct()
    # rows that repeat whole are candidates of their own, so one copy of their vector is enough
    vectors = rows.join(wanted, ["vec_id", "h"], "left_semi").dropDuplicates(["vec_id", "h"])
    met = pairs.select("query_id", "vec_id", "h").join(vectors, ["vec_id", "h"]).join(asking.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return met.select("query_id", "vec_id", dot(F.col("q"), F.col("v")).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda total, x: total + x)
