"""Small files and listings through Hadoop's file systems, so that folders may be on any store that Spark reads."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    """The files below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.base = self._path(self.root)
        self.fs = self.base.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def listing(self) -> dict[str, int]:
        """The relative path of each file, and when it changed, in milliseconds."""
        if not self.fs.exists(self.base):
            return {}
        top = self.fs.makeQualified(self.base).toString().rstrip("/")
        files, out = self.fs.listFiles(self.base, True), {}
        while files.hasNext():
            f = files.next()
            out[f.getPath().toString()[len(top) + 1 :]] = f.getModificationTime()
        return dict(sorted(out.items()))

    def read(self, name: str) -> str | None:
        """The text of a small file; none if there is none."""
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A small file, whole or not at all: it is written aside and moved into place."""
        aside = self.at(f"_{name}.new")
        stream = self.fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        qualified = self.fs.makeQualified(aside)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self.spark._jsc.hadoopConfiguration()).rename(qualified, self.fs.makeQualified(self.at(name)), options)

    def claim(self, name: str) -> bool:
        """Make an empty file that only one can make; whether it was made here."""
        if self.fs.getUri().getScheme() == "file":  # whose check and creation are two steps in Hadoop
            file = self.spark._jvm.java.io.File(self.fs.makeQualified(self.at(name)).toUri().getPath())
            file.getParentFile().mkdirs()
            return file.createNewFile()
        try:
            self.fs.create(self.at(name), False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)
