"""A Spark session with the settings that the engine is tuned for."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lectern", **conf: str) -> SparkSession:
    """Adaptive execution with skew handling; what a cluster sets itself stays."""
    builder = SparkSession.builder.appName(app)
    own = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in (own | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of an Arrow batch. Spark's own limit is 64 MB, of which a task holds a batch several times: in vectors that double as they grow, in the stream to the worker, and in the worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches that go to Python workers are bounded by bytes: files are long rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir. Only a local session, one process, may use a temporary folder without it."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lectern-")
    path = f"{base}/lectern-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(rows: DataFrame) -> DataFrame:
    """rows, written once to a folder of their own: what is read several times is worked out once, and joins know its size."""
    folder = scratch(rows.sparkSession)
    with shuffles_dropped(rows.sparkSession):
        rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind; else they lie on the disks until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Scratch folders that are made within go at its end."""
    first = len(_made)
    yield
    for own, path in _made[first:]:
        _delete(own, path)
    del _made[first:]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    """Scratch folders go when the application ends in order."""
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the session may have ended before
                _delete(spark, path)
