"""A Spark data source for the text format: spark.read.format("usfm").load(folder)."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from .usfm import read_usfm
from .usj import flatten

SCHEMA = "path string, code string, seq int, depth int, type string, marker string, text string, number_str string"


class UsfmDataSource(DataSource):
    """One partition a file; a filter on code leaves out files whose name holds another id."""

    @classmethod
    def name(cls) -> str:
        return "usfm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return UsfmReader(self.options)


class UsfmReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.code = options["path"], None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("code",):
                self.code = f.value
            yield f  # Spark checks it again: a name is a hint only

    def partitions(self) -> list[InputPartition]:
        files = sorted(p for p in Path(self.folder).rglob("*") if p.suffix.lower() in (".usfm", ".sfm"))
        if self.code:
            files = [p for p in files if self.code.lower() in p.name.lower()] or files
        return [InputPartition(str(p)) for p in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None or not partition.value:
            return
        tree, _ = read_usfm(Path(partition.value).read_text(encoding="utf-8-sig"))
        rows = flatten(tree)
        code = next((r["code"] for r in rows if r["type"] == "book"), None)
        for r in rows:
            yield (partition.value, code, r["seq"], r["depth"], r["type"], r["marker"], r["text"], r["number_str"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(UsfmDataSource)
