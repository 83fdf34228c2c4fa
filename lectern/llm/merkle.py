"""A Merkle manifest of a table, and a proof for every row.

Every row is a leaf: a digest of its fields. Within a group (a source) leaves ascend by id, and every three consecutive nodes become one, until one is left;
the groups' last nodes become the root in the same way. Digests are lowercase hex of SHA-256 wherever they are inputs; tables hold their 32 bytes.

A proof is looked up by coordinates. A node's place in its group and the group's size tell where its siblings are on each level: a leaf explodes
these coordinates, they meet the stored nodes in a join, and what comes back is put in order, concatenated and folded to a root. Levels go in
rounds of LEVELS: in a round a node asks for the siblings of its own block of 3^LEVELS nodes only, and what lies above a block is looked up once for the block. So a node of the
upper levels, which every leaf of a large group needs, is asked for by 3^LEVELS others at most, however large the group is. A block's nodes are
made from one array of 3^LEVELS digests at most, so a tree costs a shuffle of a third less each LEVELS levels.

Places are numbers of a sorted table: rows are dealt by range, sorted within tasks and stored with the row number of the task, and the rows of the tasks
before are added. No task sees a whole group.

Defined results: a null field is `-` in the leaf. Rows of a null group are a group of their own, the first. Within a group null ids come first; rows of equal ids
follow each other by their leaf, and rows that repeat whole have a leaf and a proof each (their proofs differ, as their places do). A null id has no checksum and isn't tampered
with. A text of any length is hashed whole. A group of one leaf has that leaf as its last node, a table of one group that node as its
root; a proof without siblings is the digest of no bytes. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, store

FAN, LEVELS = 3, 6
BLOCK = FAN**LEVELS
POWERS = [FAN**k for k in range(40)]  # beyond the rows of any table
#: Rows that one task numbers.
TASK_ROWS = 500_000
#: The fields of a leaf of documents.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(c: Column) -> Column:
    """Lowercase hex of the SHA-256 of a string's UTF-8 bytes, or of bytes."""
    return F.sha2(c, 256)


def leaf_digest(*fields: Column) -> Column:
    """The digest of a row's fields, each as its count of bytes, a colon and the value; `-` for null."""
    text = [c.cast("string") for c in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def height(size: Column) -> Column:
    """How many levels lie above the leaves of a group: the least k with 3^k >= size."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in POWERS]), lambda p: p < size))


def power(k: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in POWERS[: LEVELS + 1]]), k)


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def tasks_for(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def numbered(df: DataFrame, order: list[Column], tasks: int) -> DataFrame:
    """df with `place`, its row number in an order, from 0."""
    dealt = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    rows = store(dealt.withColumn("task_at", F.monotonically_increasing_id()))  # 2^33 times the task's number, and the row's place in the task
    rows = rows.withColumns({"task_no": F.shiftright("task_at", 33), "task_at": F.col("task_at").bitwiseAND((1 << 33) - 1)})
    each = rows.groupBy("task_no").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("task_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("task_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("task_start"))
    # 16 bytes a task of TASK_ROWS rows
    return rows.join(F.broadcast(starts), "task_no").withColumn("place", F.col("task_start") + F.col("task_at")).drop("task_no", "task_at", "task_start")


class Forest:
    """The nodes of many trees.

    members (grp, i, n, digest): the leaves, with their place in their group and the group's size. levels holds the stored nodes of each round
    (grp, n, level, i, digest; n and level count from the round's own lowest nodes); tops has (grp, digest) of each group's last node.
    """

    def __init__(self, members: DataFrame, largest: int):
        self.levels: list[DataFrame] = []
        tops = []
        while True:
            nodes = store(self.blocks(members))
            self.levels.append(nodes)
            tops.append(nodes.where((F.col("n") <= BLOCK) & (F.col("level") == height(F.col("n")))).select("grp", "digest"))
            if largest <= BLOCK:
                break
            members = nodes.where((F.col("n") > BLOCK) & (F.col("level") == LEVELS)).select("grp", "i", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), "digest")
            largest = -(-largest // BLOCK)
        self.tops = reduce(DataFrame.union, tops)

    @staticmethod
    def blocks(members: DataFrame) -> DataFrame:
        """The nodes of one round: of each block of 3^LEVELS members, its levels."""
        block = F.floor(F.col("i") / BLOCK).cast("long")
        held = members.groupBy("grp", "n", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "digest"))).alias("held"))  # 3^LEVELS at most

        def up(below: Column) -> Column:
            runs = F.sequence(F.lit(0), F.ceil(F.size(below) / FAN).cast("int") - 1)
            return F.transform(runs, lambda k: F.unhex(digest(F.array_join(F.transform(F.slice(below, k * FAN + 1, F.lit(FAN)), hexed), ""))))

        steps = F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), lambda k: k <= height(F.col("n")))
        lowest = F.transform("held", lambda x: x["digest"])
        levels = F.aggregate(steps, F.array(lowest), lambda made, _: F.concat(made, F.array(up(F.element_at(made, -1)))))
        rows = held.select("grp", "n", "block", F.posexplode(levels).alias("level", "nodes"))
        first = F.col("block") * power(F.lit(LEVELS) - F.col("level"))
        return rows.select("grp", "n", "level", first.alias("first"), F.posexplode("nodes").alias("at", "digest")).select("grp", "n", "level", (F.col("first") + F.col("at")).alias("i"), "digest")

    @staticmethod
    def coordinates(members: DataFrame) -> DataFrame:
        """(grp, me, level, i, left) of every sibling that the members (grp, i, n) need on the levels of a round."""
        i, n = F.col("i"), F.col("n")

        def of_level(k: Column) -> Column:
            own = F.floor(i / power(k)).cast("long")
            run = own - own % FAN
            there = F.filter(F.sequence(run, run + (FAN - 1)), lambda j: (j != own) & (j * power(k) < n))
            return F.transform(there, lambda j: F.struct(k.alias("level"), j.alias("i"), (j < own).alias("left")))

        needed = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: k < height(n))
        return members.select("grp", F.col("i").alias("me"), F.inline(F.flatten(F.transform(needed, of_level))))

    def siblings(self, members: DataFrame, k: int) -> DataFrame:
        """(grp, me, level, left, i, digest): what the members' coordinates of round k find among its stored nodes."""
        return self.coordinates(members).join(self.levels[k].select("grp", "level", "i", "digest"), ["grp", "level", "i"])

    @staticmethod
    def path(found: Column, n: Column) -> Column:
        """The siblings of one member in order: for each level of the round what stands left and right of it, concatenated."""
        here = F.array_sort(found)

        def side(k: Column, left: bool) -> Column:
            return F.array_join(F.transform(F.filter(here, lambda x: (x["level"] == k) & (x["left"] == left)), lambda x: hexed(x["digest"])), "")

        needed = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: k < height(n))
        return F.transform(needed, lambda k: F.struct(side(k, True).alias("left"), side(k, False).alias("right")))

    def paths(self, members: DataFrame, k: int, above: DataFrame) -> DataFrame:
        """members (grp, i, n, and more) of round k with their path to the top, and the further columns of `above`, which has the (grp, i, path) of the blocks they are in.

        All rows of a block go to one task from here on: 3^LEVELS members and their siblings.
        """
        more = [c for c in members.columns if c not in ("grp", "i", "n")]
        own = members.select("grp", F.col("i").alias("me"), "n", F.struct(*[F.col(c) for c in more]).alias("own") if more else F.struct(F.lit(0).alias("none")).alias("own"), F.lit(None).cast("struct<level: int, i: bigint, left: boolean, digest: binary>").alias("found"))
        asked = self.siblings(members.select("grp", "i", "n"), k)
        met = asked.select("grp", "me", F.lit(None).cast("long").alias("n"), F.lit(None).cast(own.schema["own"].dataType).alias("own"), F.struct("level", "i", "left", "digest").alias("found"))
        block = F.floor(F.col("me") / BLOCK).cast("long").alias("block")
        rows = own.union(met).withColumn("block", block).repartition("grp", "block")
        each = rows.groupBy("grp", "block", "me").agg(F.max("n").alias("n"), F.max("own").alias("own"), F.collect_list("found").alias("found"))
        each = each.select("grp", "block", F.col("me").alias("i"), "n", "own", self.path(F.col("found"), F.col("n")).alias("path"))
        upper = above.withColumnsRenamed({"i": "block", "path": "upper"})
        joined = each.join(upper, ["grp", "block"])
        kept = [c for c in upper.columns if c not in ("grp", "block", "upper")]
        return joined.select("grp", "i", *[F.col("own")[c].alias(c) for c in more], *kept, F.concat("path", "upper").alias("path"))

    def to_top(self, members: DataFrame, tops: DataFrame) -> DataFrame:
        """members (grp, i, n, and more) with the path to the end of `tops` (grp, path, and more), which continues above each group."""
        counts = members.select("grp", "n").distinct() if len(self.levels) > 1 else None
        above = tops.withColumn("i", F.lit(0).cast("long"))
        for k in range(len(self.levels) - 1, 0, -1):
            # the blocks of round k - 1 are the members of round k
            size = F.ceil(F.col("n") / BLOCK**k).cast("long")
            part = counts.where(F.col("n") > BLOCK**k).select("grp", size.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("i"))
            reached = self.paths(part, k, above)
            above = reached.unionByName(above.join(counts.where(F.col("n") <= BLOCK**k).select("grp"), "grp", "left_semi"))
        return self.paths(members, 0, above)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's hex digest and a path lead to."""
    return F.aggregate(path, start, lambda h, x: digest(F.concat(x["left"], h, x["right"])))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def manifest(rows: DataFrame) -> tuple[DataFrame, str | None]:
    """rows (id, grp, leaf, and more) with subroot and path to the root, and the root (None of no rows). leaf is hex; so are the results."""
    spark = rows.sparkSession
    slim = store(rows.withColumn("leaf", F.unhex("leaf")).withColumn("tie", F.monotonically_increasing_id()))
    count = slim.count()
    placed = numbered(slim, [F.col("grp"), F.col("id"), F.col("leaf"), F.col("tie")], tasks_for(spark, count))
    forget(slim)
    groups = placed.groupBy(F.col("grp").alias("name")).agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    groups = store(groups)
    n_groups, largest = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    ranked = numbered(groups, [F.col("name")], tasks_for(spark, n_groups)).withColumnRenamed("place", "number")
    # a hot group's side is split by the adaptive join; the other has a row a group
    leaves = placed.join(ranked, F.col("grp").eqNullSafe(F.col("name"))).select(
        F.col("number").alias("grp"), (F.col("place") - F.col("start")).alias("i"), "n", F.col("leaf").alias("digest"), *[c for c in rows.columns if c not in ("grp", "leaf")]
    )
    leaves = store(leaves)
    trees = Forest(leaves.select("grp", "i", "n", "digest"), largest or 1)
    tops = trees.tops.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("i"), F.lit(n_groups).cast("long").alias("n"), "digest")
    upper = Forest(tops, n_groups or 1)
    root = next((bytes(r["digest"]).hex() for r in upper.tops.take(1)), None)
    end = spark.range(1).select(F.lit(0).cast("long").alias("grp"), F.array().cast("array<struct<left: string, right: string>>").alias("path"))
    over = upper.to_top(tops.select("grp", "i", "n", F.col("digest").alias("subroot")), end).select(F.col("i").alias("grp"), "subroot", "path")
    proved = trees.to_top(leaves, over)
    more = [c for c in rows.columns if c not in ("grp", "leaf")]
    return proved.select(*more, hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), "path"), root


def document_leaves(docs: DataFrame) -> DataFrame:
    """id, grp, leaf of every document, and `tampered`, its leaf without line feeds where its id's checksum is even (null: untouched)."""
    own = [F.col(c) for c in FIELDS]
    without = leaf_digest(*own[:-1], F.replace(own[-1], F.lit("\n"), F.lit("")))
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = F.when(even & F.contains(own[-1], F.lit("\n")), F.unhex(without))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").alias("grp"), leaf_digest(*own).alias("leaf"), changed.alias("tampered"))


def verify(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document, tampered with as document_leaves says."""
    proved, root = manifest(document_leaves(docs))
    start = F.coalesce(hexed(F.col("tampered")), F.col("leaf"))
    out = proved.select(F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), fold(start, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def root_of(rows: DataFrame) -> str | None:
    """The root alone, as a fingerprint of rows (id, grp, leaf)."""
    return manifest(rows)[1]
