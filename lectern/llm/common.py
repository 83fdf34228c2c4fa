"""Shared helpers of the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space that the contracts name: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch: texts can be long, and a worker holds a batch in several forms.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Ready the session for Python stages: batches bounded by bytes, and this package on the executors.

    The package is sent unless executors find it by PYTHONPATH or in their working folder.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    paths = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p} | {os.getcwd()}
    sc = spark.sparkContext
    if str(ROOT) in paths or getattr(sc, "_lectern_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "lectern_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "lectern").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._lectern_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share: spark.checkpoint.dir.

    Without it, a folder of this machine serves a local session, where driver and executor are one process; on a cluster that would
    lose data, so it is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def lean(stage: Callable) -> Callable:
    """A stage over batches whose worker, when it ends, gives back the memory that its caches and batches took.

    Workers are kept for later stages and would hold it meanwhile.
    """

    @functools.wraps(stage)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from stage(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the C library that has it
        pass


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, other characters as they are. Text of bytes below 128 takes the faster way, which is the same there."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def hash128(c: Column) -> tuple[Column, Column]:
    """Two differently seeded 64-bit hashes of a column; together a 128-bit key."""
    return F.xxhash64(c), F.xxhash64(F.lit(7), c)


#: The folders of the tables that store() made, innermost scope last.
_scopes: list[list[tuple[SparkSession, str]]] = [[]]


def store(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder as a table and read it back: lineage ends there and any executor may be lost.

    Tables of an application share a folder, which goes when the application ends in order; see also forget() and scope().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scopes[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*stored: DataFrame) -> None:
    """Delete tables of store() that nothing reads any more."""
    for df in stored:
        path = df._stored_at
        _delete(df.sparkSession, path)
        for made in _scopes:
            made[:] = [x for x in made if x[1] != path]


@contextlib.contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What store() makes inside is deleted at the end, but for the tables given to the function that it yields."""
    _scopes.append([])

    def keep(df: DataFrame) -> DataFrame:
        for x in [x for x in _scopes[-1] if x[1] == df._stored_at]:
            _scopes[-1].remove(x)
            _scopes[-2].append(x)
        return df

    try:
        yield keep
    finally:
        for spark, path in _scopes.pop():
            _delete(spark, path)


@atexit.register
def _clear() -> None:
    for spark, path in (x for made in _scopes for x in made):
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the session may have ended before
                _delete(spark, path)
