"""Corpora on disk: folders and zip files of documents, and their configuration."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = ("png", "jpg", "jpeg", "gif", "svg", "webp", "tif", "tiff", "bmp")
CONFIG_NAME = "corpus.toml"
OLD_CONFIG_NAMES = ("bible.toml",)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def kind_of(path: Column) -> Column:
    """config, usj, usfm, image or other, by name and last extension."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    e = extension(path)
    return F.when(name.isin(CONFIG_NAME, *OLD_CONFIG_NAMES), "config").when(e == "usj", "usj").when(e.isin("usfm", "sfm"), "usfm").when(e.isin(*IMAGES), "image").otherwise("other")


def read_files(spark: SparkSession, root: str, disabled: frozenset[str] = frozenset()) -> DataFrame:
    """(corpus_id, path, kind, text) of every document and configuration below root.

    Each folder of root is a corpus, and each zip file, whose stem is its id. Other files are left to `skipped`.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return unpack(raw, root, disabled)


def unpack(raw: DataFrame, root: str, disabled: frozenset[str] = frozenset()) -> DataFrame:
    """binaryFile rows as files; zip entries become files of their own, an entry at a time."""
    base = root.rstrip("/").rpartition("/")[2]
    below = F.regexp_extract("path", rf"/{base}/(.+)$", 1)
    rows = raw.select(below.alias("below"), "content")

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["below"], batch["content"], strict=True):
                corpus, _, rest = path.partition("/")
                if not rest and path.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for entry in z.namelist():
                            if not entry.endswith(("/", "\\")):
                                yield one(path[:-4], entry, z.read(entry))
                elif rest:
                    yield one(corpus, rest, content)

    def one(corpus: str, path: str, content: bytes) -> pd.DataFrame:
        return pd.DataFrame({"corpus_id": [corpus], "path": [path], "text": [content.decode("utf-8-sig", "replace")]}, dtype=object)

    files = rows.mapInPandas(expand, "corpus_id string, path string, text string").withColumn("kind", kind_of(F.col("path")))
    return files.where(~F.col("corpus_id").isin(*disabled)) if disabled else files


def documents(files: DataFrame) -> DataFrame:
    return files.where(F.col("kind").isin("usj", "usfm"))


def configs(files: DataFrame) -> dict[str, str]:
    """The configuration text of each corpus: one small file a corpus."""
    return {r["corpus_id"]: r["text"] for r in files.where("kind = 'config'").select("corpus_id", "text").collect()}


def skipped(files: DataFrame) -> DataFrame:
    """Files that nothing reads; images are no surprise."""
    return files.where("kind = 'other'").select("corpus_id", "path")
